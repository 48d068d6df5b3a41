"""Queues, progress and telemetry over logs of rows in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKOFF_MINUTES = (10, 45, 120)


def window_totals(rows: DataFrame, ts: str, until: str, hours: float, sums: dict[str, Column]) -> DataFrame:
    """Sums over the last hours, both ends included, and the rate of the first sum an hour (0 without hours)."""
    end = F.lit(until).cast("timestamp")
    inside = rows.filter((F.col(ts) <= end) & (F.col(ts) >= end - F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600})")))
    out = inside.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()))
    first = next(iter(sums))
    return out.withColumn("per_hour", F.round(F.col(first) / F.lit(float(hours)), 6) if hours > 0 else F.lit(0.0))


def trailing_streaks(rows: DataFrame, group: str, order: list[str], hit: Column) -> DataFrame:
    """Per group: rows, hits, and how many of the last rows are hits without a break.

    The streak is the rows after the last miss: two aggregates, no window.
    """
    at = F.struct(*order)
    marked = rows.select(group, at.alias("at_"), F.coalesce(hit, F.lit(False)).alias("hit_"))
    last = marked.filter(~F.col("hit_")).groupBy(group).agg(F.max("at_").alias("last_"))
    after = marked.join(last, group, "left")
    return after.groupBy(group).agg(F.count("*").alias("n"), F.count_if("hit_").alias("hits"), F.count_if(F.col("last_").isNull() | (F.col("at_") > F.col("last_"))).alias("streak"))


def remaining(raw: DataFrame, done: DataFrame, given_up: DataFrame, key: str) -> DataFrame:
    """raw - done - given_up."""
    return raw.select(key).distinct().join(done.select(key), key, "left_anti").join(given_up.select(key), key, "left_anti")


def given_up(attempts: DataFrame, done: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """Keys with at least ``most`` attempts that never succeeded."""
    tried = attempts.groupBy(key).agg(F.sum(F.coalesce(count, F.lit(1))).alias("attempts")).filter(F.col("attempts") >= most)
    return tried.join(done.select(key).distinct(), key, "left_anti")


def backoff_minutes(attempts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BACKOFF_MINUTES)), F.least(F.greatest(attempts, F.lit(0)), F.lit(2)).cast("int") + 1)


def next_retry(state: DataFrame, seen: DataFrame, key: str, now: str) -> DataFrame:
    """New state (key, attempts, retry_after): a cooldown starts where attempts rose, else the old one stays."""
    a, b = state.select(key, F.col("attempts").alias("old_"), "retry_after"), seen.select(key, F.col("attempts").alias("new_"))
    rose = F.coalesce("new_", F.lit(0)) > F.coalesce("old_", F.lit(0))
    wait = backoff_minutes(F.col("new_") - 1)
    later = F.lit(now).cast("timestamp") + F.make_interval(mins=wait)
    return a.join(b, key, "full").select(key, F.greatest(F.coalesce("old_", F.lit(0)), F.coalesce("new_", F.lit(0))).alias("attempts"), F.when(rose, later).otherwise(F.col("retry_after")).alias("retry_after"))


def dominant(rows: DataFrame, group: str, part: str, value: str) -> DataFrame:
    """Per group the part with the largest sum (ties: the smaller name) and its share of the total."""
    sums = rows.groupBy(group, part).agg(F.sum(value).alias("v"))
    best = sums.groupBy(group).agg(F.max_by(part, F.struct("v", F.lit(0))).alias("any_"), F.max("v").alias("most"), F.sum("v").alias("total"))
    tie = sums.join(best, group).filter(F.col("v") == F.col("most")).groupBy(group).agg(F.min(part).alias(part), F.first("most").alias("most"), F.first("total").alias("total"))
    return tie.select(group, part, F.round(F.coalesce(F.try_divide("most", "total"), F.lit(0.0)), 6).alias("share"))


def funnel(rows: DataFrame, user: str, step: str, steps: list[str]) -> DataFrame:
    """How many users have the first k steps, for each k."""
    has = rows.filter(F.col(step).isin(steps)).groupBy(user).agg(*(F.max((F.col(step) == s).cast("int")).alias(f"s{i}_") for i, s in enumerate(steps)))
    reach = [sum((F.col(f"s{j}_") for j in range(1, i + 1)), F.col("s0_")) == i + 1 for i in range(len(steps))]
    n = has.agg(*(F.count_if(r).alias(f"n{i}") for i, r in enumerate(reach)))
    return n.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("place"), F.lit(s).alias("step"), F.col(f"n{i}").alias("users")) for i, s in enumerate(steps)))).alias("x")).select("x.*")


def sample_quota(rows: DataFrame, stratum: str, key: str, share: float, seed: int) -> DataFrame:
    """A share of each stratum (rounded half up), by the order of a seeded hash; the same rows each time."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy(stratum).orderBy(order, key)
    size = rows.groupBy(F.col(stratum).alias("s_")).agg(F.floor(F.count("*") * share + 0.5).cast("long").alias("quota_"))
    return rows.withColumn("n_", F.row_number().over(w)).join(size, F.col(stratum).eqNullSafe(F.col("s_"))).filter("n_ <= quota_").drop("n_", "s_", "quota_")


def repaired_quotas(sizes: DataFrame, stratum: str, count: str, total: int) -> DataFrame:
    """(stratum, quota): shares of ``total`` in proportion, rounded down, the rest to the largest remainders (ties by name)."""
    all_ = sizes.agg(F.sum(count).alias("all_"))
    exact = F.col(count) * total / F.col("all_")
    parts = sizes.crossJoin(F.broadcast(all_)).withColumn("base_", F.floor(exact)).withColumn("rest_", F.round(exact - F.floor(exact), 9))
    short = parts.agg((F.lit(total) - F.sum("base_")).alias("short_"))
    place = F.row_number().over(Window.orderBy(F.desc("rest_"), stratum))  # strata are few
    return parts.withColumn("p_", place).crossJoin(F.broadcast(short)).select(stratum, (F.col("base_") + (F.col("p_") <= F.col("short_")).cast("long")).alias("quota"))
