"""Work queues as tables: results of attempts, cooldowns, what is left and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .monitor import backoff_minutes

# The states of an entry.
PENDING, ERROR, CHUNKED, DONE, EMPTY, CHALLENGED = "pending", "error", "chunked", "done", "empty_unexpected", "challenged"
#: What blocks a session, in the order to test: marker in the message, class.
BLOCKS = (("captcha", "challenge"), ("403", "forbidden"), ("429", "rate_limit"), ("timeout", "timeout"))


def seed(state: DataFrame, seeds: DataFrame, key: str, refreshed: list[str]) -> DataFrame:
    """New keys as pending; of known ones only ``refreshed`` columns change, never their progress."""
    new = seeds.select(key, *(F.col(c).alias(f"{c}_") for c in refreshed))
    out = state.join(new.withColumn("seeded_", F.lit(True)), key, "full")
    fresh = {c: F.when(F.col("seeded_"), F.col(f"{c}_")).otherwise(F.col(c)) for c in refreshed}
    start = {"status": F.coalesce("status", F.lit(PENDING)), "attempts": F.coalesce("attempts", F.lit(0)), "plain_timeouts": F.coalesce("plain_timeouts", F.lit(0))}
    return out.select(*(({**fresh, **start}).get(c, F.col(c)).alias(c) for c in state.columns))


def record_results(state: DataFrame, results: DataFrame, key: str, now: str) -> DataFrame:
    """The state after one result (key, status) for some keys.

    Progress (done, chunked) clears the attempts; anything else adds one.  Errors and unexpectedly empty
    results wait by the number of earlier attempts; a challenge waits for a person.  Plain timeouts in a row
    are counted for errors only.
    """
    out = state.join(results.select(key, F.col("status").alias("new_")), key, "left")
    progress = F.col("new_").isin(DONE, CHUNKED)
    at = F.lit(now).cast("timestamp")
    waits = F.col("new_").isin(ERROR, EMPTY)
    changed = {
        "status": F.col("new_"),
        "attempts": F.when(progress, 0).otherwise(F.col("attempts") + 1),
        "plain_timeouts": F.when(~progress & (F.col("new_") == ERROR), F.col("plain_timeouts") + 1).otherwise(0),
        "next_retry_at": F.when(waits, at + F.make_interval(mins=backoff_minutes(F.col("attempts")))),
        "last_attempt_at": at,
    }
    return out.select(*(F.when(F.col("new_").isNotNull(), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in state.columns))


def due(state: DataFrame, most: int, now: str) -> DataFrame:
    """Entries to try: pending, failed or part done, under the limit of attempts, and not cooling down."""
    ready = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.lit(now).cast("timestamp"))
    return state.filter(F.col("status").isin(PENDING, ERROR, CHUNKED) & (F.col("attempts") < most) & ready)


def reset(state: DataFrame, hit: Column) -> DataFrame:
    """Rows that ``hit`` names are pending again, without attempts or cooldown."""
    start = {"status": F.lit(PENDING), "attempts": F.lit(0), "plain_timeouts": F.lit(0), "next_retry_at": F.lit(None).cast("timestamp")}
    return state.select(*(F.when(hit, start[c]).otherwise(F.col(c)).alias(c) if c in start else F.col(c) for c in state.columns))


def parsed_time(x: Column) -> Column:
    """A time in ISO form; without a zone it is UTC, malformed it is null."""
    return F.try_to_timestamp(F.when(x.rlike(r"([+-]\d{2}:?\d{2}|Z)$"), x).otherwise(F.concat(x, F.lit("+00:00"))))


def cooling(retries: DataFrame, key: str, retry_after: str, now: str) -> DataFrame:
    """Keys whose time to retry is still to come; malformed times are none."""
    return retries.filter(parsed_time(F.col(retry_after)) > F.lit(now).cast("timestamp")).select(key).distinct()


def cooldowns(attempts: DataFrame, state: DataFrame, done: DataFrame, key: str, hours: float, now: str) -> DataFrame:
    """(key, attempts, retry_after): a cooldown starts where attempts rose above those known; done keys drop out."""
    a = attempts.select(key, F.col("attempts").alias("new_")).join(done.select(key), key, "left_anti")
    out = a.join(state.select(key, F.col("attempts").alias("old_"), "retry_after"), key, "left")
    rose = F.col("old_").isNull() | (F.col("new_") > F.col("old_"))
    later = F.lit(now).cast("timestamp") + F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600})")
    return out.select(key, F.when(rose, F.col("new_")).otherwise(F.col("old_")).alias("attempts"), F.when(rose, later).otherwise(F.col("retry_after")).alias("retry_after"))


def ordered(remaining: DataFrame, attempted: DataFrame, popularity: DataFrame, key: str) -> DataFrame:
    """remaining with ``is_retry`` and the popularity columns: sort by is_retry, then popularity falling, then key.

    The frame is sorted by a range exchange, so that writing it keeps the order over files.
    """
    tried = attempted.select(key).distinct().withColumn("is_retry", F.lit(1))
    known = [c for c in popularity.columns if c != key]
    out = remaining.join(tried, key, "left").join(popularity, key, "left").select(key, F.coalesce("is_retry", F.lit(0)).alias("is_retry"), *(F.coalesce(c, F.lit(0)).alias(c) for c in known))
    return out.orderBy("is_retry", *(F.desc(c) for c in known), key)


def head_without_signal(queue: DataFrame, place: str, signal: str, head: int) -> DataFrame:
    """One row: whether the first ``head`` entries have no signal although a tenth of the queue has some."""
    n = queue.agg(F.count_if((F.col(place) <= head) & (F.col(signal) > 0)).alias("head_with"), F.count_if(F.col(signal) > 0).alias("with"), F.count("*").alias("n"))
    return n.select("head_with", "with", "n", ((F.col("head_with") == 0) & (F.col("with") >= 0.1 * F.col("n")) & (F.col("n") > 0)).alias("poor_head"))


def chunk_warns(trailing: Column, n: Column, warned: Column) -> Column:
    """Eight warnings at the end, or twenty rows of which four in five are warnings."""
    return (trailing >= 8) | ((n >= 20) & (F.coalesce(F.try_divide(warned, n), F.lit(0.0)) >= 0.8))


def block_class(message: Column) -> Column:
    """The first class in ``BLOCKS`` whose marker a message holds; null without one."""
    found = None
    for marker, name in BLOCKS:
        hit = F.contains(F.lower(message), F.lit(marker))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def next_step(blocked: Column, rotations: Column, most: int) -> Column:
    """rotate while blocked and rotations are left, then cool down; continue without a block."""
    return F.when(blocked == 0, "continue").when(rotations < most, "rotate").when(blocked < 3, "cooldown").otherwise("stop")


def tier_seconds(tier: Column, tiers: tuple[int, ...], low: int = 60, high: int = 180) -> Column:
    """The cooldown of a tier (the last one beyond), kept within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.element_at(F.array(*map(F.lit, tiers)), F.least(F.greatest(tier, F.lit(0)), F.lit(len(tiers) - 1)).cast("int") + 1)))


def rate(ok: Column, n: Column, minutes: Column) -> Column:
    """struct(success, per_minute), each 0 without rows or time."""
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    return F.struct(share(ok, n).alias("success"), share(n, minutes).alias("per_minute"))


def successor(ring: Column, current: Column) -> Column:
    """The entry after the current one in a ring; the first one where the current is unknown."""
    at = F.array_position(ring, current).cast("int")
    return F.element_at(ring, F.pmod(at, F.size(ring)) + 1)
