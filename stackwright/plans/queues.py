"""Queues, sessions and telemetry: state after results, what is due, cooldowns, order, warnings, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators import lists, monitor, queue

from .tables import register, t

QUERIES, SQL, query = register()

NOW = "2024-02-01 00:00:00"

_STATE = """st AS (SELECT c_custkey AS list_id, lower(c_mktsegment) AS genre, ['pending', 'error', 'chunked', 'done', 'challenged', 'empty_unexpected'][c_custkey % 6 + 1] AS status, (c_custkey % 5)::INT AS attempts, (c_custkey % 4)::INT AS plain_timeouts,
 CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 MINUTE * (c_custkey % 121 - 60) END AS next_retry_at, NULL::TIMESTAMP AS last_attempt_at FROM customer),
rs AS (SELECT c_custkey AS list_id, ['done', 'error', 'chunked', 'empty_unexpected', 'challenged'][c_custkey % 5 + 1] AS new FROM customer WHERE c_custkey % 7 <> 0)"""


def _state(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), at.cast("int") + 1)
    status = pick([queue.PENDING, queue.ERROR, queue.CHUNKED, queue.DONE, queue.CHALLENGED, queue.EMPTY], k % 6)
    retry = F.when(k % 3 == 0, F.lit(NOW).cast("timestamp") + F.make_interval(mins=(k % 121 - 60).cast("int")))
    return t(spark, d, "customer").select(k.alias("list_id"), F.lower("c_mktsegment").alias("genre"), status.alias("status"), (k % 5).cast("int").alias("attempts"), (k % 4).cast("int").alias("plain_timeouts"), retry.alias("next_retry_at"), F.lit(None).cast("timestamp").alias("last_attempt_at"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    new = F.element_at(F.array(*map(F.lit, [queue.DONE, queue.ERROR, queue.CHUNKED, queue.EMPTY, queue.CHALLENGED])), (k % 5).cast("int") + 1)
    return t(spark, d, "customer").filter("c_custkey % 7 <> 0").select(k.alias("list_id"), new.alias("status"))


_AFTER = """af AS (SELECT list_id, genre, coalesce(new, status) AS status, CASE WHEN new IS NULL THEN attempts WHEN new IN ('done', 'chunked') THEN 0 ELSE attempts + 1 END AS attempts,
 CASE WHEN new IS NULL THEN plain_timeouts WHEN new = 'error' THEN plain_timeouts + 1 ELSE 0 END AS plain_timeouts,
 CASE WHEN new IS NULL THEN next_retry_at WHEN new IN ('error', 'empty_unexpected') THEN TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 MINUTE * [10, 45, 120][least(attempts, 2) + 1] END AS next_retry_at,
 CASE WHEN new IS NULL THEN last_attempt_at ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_attempt_at FROM st LEFT JOIN rs USING (list_id))"""


def _after(spark: SparkSession, d: str) -> DataFrame:
    return queue.record_results(_state(spark, d), _results(spark, d), "list_id", NOW)


@query(f"WITH {_STATE}, {_AFTER} SELECT list_id, status, attempts, plain_timeouts, coalesce(epoch(next_retry_at)::BIGINT, -1) AS retry_s, coalesce(epoch(last_attempt_at)::BIGINT, -1) AS last_s FROM af")
def state_after_results(spark: SparkSession, d: str) -> DataFrame:
    seconds = lambda c, n: F.coalesce(F.unix_timestamp(c), F.lit(-1)).alias(n)
    return _after(spark, d).select("list_id", "status", "attempts", "plain_timeouts", seconds("next_retry_at", "retry_s"), seconds("last_attempt_at", "last_s"))


@query(f"WITH {_STATE}, {_AFTER} SELECT list_id, status, attempts FROM af WHERE status IN ('pending', 'error', 'chunked') AND attempts < 4 AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-02-01 00:30:00')")
def due_entries(spark: SparkSession, d: str) -> DataFrame:
    return queue.due(_after(spark, d), 4, "2024-02-01 00:30:00").select("list_id", "status", "attempts")


@query(f"WITH {_STATE} SELECT list_id, CASE WHEN list_id % 11 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN list_id % 11 = 0 THEN 0 ELSE attempts END AS attempts, list_id % 11 <> 0 AND next_retry_at IS NOT NULL AS cooling FROM st")
def reset_entries(spark: SparkSession, d: str) -> DataFrame:
    return queue.reset(_state(spark, d), F.col("list_id") % 11 == 0).select("list_id", "status", "attempts", F.col("next_retry_at").isNotNull().alias("cooling"))


@query(f"WITH {_STATE}, s AS (SELECT s_suppkey * 7 AS list_id, 'g' || s_nationkey AS genre FROM supplier) SELECT coalesce(st.list_id, s.list_id) AS list_id, coalesce(s.genre, st.genre) AS genre, coalesce(st.status, 'pending') AS status, coalesce(st.attempts, 0) AS attempts FROM st FULL JOIN s ON st.list_id = s.list_id")
def seeded_entries(spark: SparkSession, d: str) -> DataFrame:
    seeds = t(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("list_id"), F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("genre"))
    return queue.seed(_state(spark, d), seeds, "list_id", ["genre"]).select("list_id", "genre", "status", "attempts")


@query(f"WITH {_STATE}, {_AFTER} SELECT status, count(*)::BIGINT AS n, count(*) FILTER (next_retry_at > TIMESTAMP '2024-02-01 00:00:00')::BIGINT AS cooling FROM af GROUP BY status")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return _after(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("next_retry_at") > F.lit(NOW).cast("timestamp")).alias("cooling"))


_TRIES = "a AS (SELECT user_id AS id, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY 1), o AS (SELECT user_id AS id, count(*) AS attempts FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-10 00:00:00' AND user_id % 3 > 0 GROUP BY 1), dn AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase' AND user_id % 4 = 0)"


@query(f"WITH {_TRIES} SELECT a.id, CASE WHEN o.attempts IS NULL OR a.attempts > o.attempts THEN a.attempts ELSE o.attempts END::BIGINT AS attempts, epoch(CASE WHEN o.attempts IS NULL OR a.attempts > o.attempts THEN TIMESTAMP '2024-02-01 06:00:00' ELSE TIMESTAMP '2024-01-20 00:00:00' END)::BIGINT AS retry_s FROM a LEFT JOIN o USING (id) WHERE a.id NOT IN (SELECT id FROM dn)")
def cooldown_state(spark: SparkSession, d: str) -> DataFrame:
    """A cooldown starts where warnings rose; done ids leave the state."""
    e = t(spark, d, "events")
    err = e.filter("event_type = 'error'")
    a = err.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("attempts"))
    old = err.filter("ts < timestamp'2024-01-10 00:00:00' and user_id % 3 > 0").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("attempts")).withColumn("retry_after", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    done = e.filter("event_type = 'purchase' and user_id % 4 = 0").select(F.col("user_id").alias("id")).distinct()
    return queue.cooldowns(a, old, done, "id", 6, NOW).select("id", "attempts", F.unix_timestamp("retry_after").alias("retry_s"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 4 AND c_custkey % 50 > 24")
def cooling_ids(spark: SparkSession, d: str) -> DataFrame:
    """Times in ISO form with and without a zone, and some that are none."""
    k = F.col("c_custkey")
    hour = F.lpad((k % 50 % 24).cast("string"), 2, "0")
    day = F.when(k % 50 > 24, "2024-02-03").otherwise("2024-01-30")
    text = F.when(k % 5 == 4, "soon").when(k % 5 == 3, F.concat(day, F.lit("T"), hour, F.lit(":00:00"))).otherwise(F.concat(day, F.lit("T"), hour, F.lit(":00:00+00:00")))
    return queue.cooling(t(spark, d, "customer").select(k.alias("id"), text.alias("retry_after")), "id", "retry_after", "2024-02-02 00:00:00")


_ORDER = """l AS (SELECT l_partkey AS id, max(l_extendedprice) AS ratings, count(*) AS appearances FROM lineitem GROUP BY 1), tr AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
q AS (SELECT p_partkey AS id, (tr.id IS NOT NULL)::INT AS is_retry, coalesce(ratings, 0) AS ratings, coalesce(appearances, 0) AS appearances FROM part LEFT JOIN l ON l.id = p_partkey LEFT JOIN tr ON tr.id = p_partkey)"""


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem")
    pop = x.groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("ratings"), F.count("*").alias("appearances"))
    tried = x.filter("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_partkey").alias("id"))
    return queue.ordered(t(spark, d, "part").select(F.col("p_partkey").alias("id")), tried, pop, "id")


@query(f"WITH {_ORDER} SELECT id, is_retry, appearances::BIGINT AS appearances, row_number() OVER (ORDER BY is_retry, ratings DESC, appearances DESC, id)::BIGINT AS place FROM q")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    """New ids first, then retries, each by popularity; places over all rows."""
    from stackwright.operators import etl

    q = _ordered(spark, d)
    placed = etl.running_totals(q, [F.col("is_retry"), -F.col("ratings"), -F.col("appearances"), F.col("id")], F.lit(1), "place")
    return placed.select("id", "is_retry", "appearances", (F.col("place") + 1).cast("long").alias("place"))


@query(f"WITH {_ORDER}, p AS (SELECT *, row_number() OVER (ORDER BY id) AS place FROM q) SELECT count(*) FILTER (place <= 5 AND is_retry > 0)::BIGINT AS head_with, count(*) FILTER (is_retry > 0)::BIGINT AS \"with\", count(*)::BIGINT AS n, count(*) FILTER (place <= 5 AND is_retry > 0) = 0 AND count(*) FILTER (is_retry > 0) >= 0.1 * count(*) AS poor_head FROM p")
def queue_head(spark: SparkSession, d: str) -> DataFrame:
    q = _ordered(spark, d).withColumn("place", F.col("id") + 1)
    return queue.head_without_signal(q, "place", "is_retry", 5)


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('error', 'view')) AS hits FROM events GROUP BY 1), l AS (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1),
s AS (SELECT e.user_id, count(*) FILTER (l.last IS NULL OR (e.ts, e.event_id) > l.last) AS streak FROM events e LEFT JOIN l USING (user_id) GROUP BY 1)
SELECT user_id, streak >= 8 OR (n >= 20 AND hits / n >= 0.8) AS warn, CASE WHEN hits % 4 = 0 THEN 'continue' WHEN streak < 2 THEN 'rotate' WHEN hits % 4 < 3 THEN 'cooldown' ELSE 'stop' END AS step, least(180, greatest(60, [30, 90, 240][least(streak, 2) + 1]))::INT AS seconds FROM g JOIN s USING (user_id)""")
def session_health(spark: SparkSession, d: str) -> DataFrame:
    s = monitor.trailing_streaks(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"))
    return s.select("user_id", queue.chunk_warns(F.col("streak"), F.col("n"), F.col("hits")).alias("warn"), queue.next_step(F.col("hits") % 4, F.col("streak"), 2).alias("step"), queue.tier_seconds(F.col("streak"), (30, 90, 240)).alias("seconds"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'captcha') THEN 'challenge' WHEN contains(lower(text), '403') THEN 'forbidden' WHEN contains(lower(text), '429') THEN 'rate_limit' WHEN contains(lower(text), 'timeout') THEN 'timeout' END AS class FROM documents")
def block_classes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", queue.block_class(F.col("text")).alias("class"))


@query("SELECT user_id, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS success, round(coalesce(count(*) / nullif(user_id % 5, 0), 0), 6) AS per_minute FROM events GROUP BY user_id")
def pacing(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count("*").alias("n"))
    return g.select("user_id", queue.rate(F.col("ok"), F.col("n"), F.nullif(F.col("user_id") % 5, F.lit(0))).alias("r")).select("user_id", "r.*")


# --- telemetry reports -----------------------------------------------------------------------------

_RUNS = "r AS (SELECT user_id AS run, event_type AS kind, count(*) AS n, round(sum(value), 4) AS elapsed FROM events GROUP BY ALL), f AS (SELECT run, sum(n) AS n, sum(n) FILTER (kind = 'error') AS errors, round(sum(elapsed), 4) AS elapsed FROM r GROUP BY run)"


@query(f"WITH {_RUNS}, x AS (SELECT 'FAILED' AS rule, run FROM f WHERE errors >= 0.25 * n UNION ALL SELECT * FROM (SELECT 'SLOW', run FROM f ORDER BY elapsed DESC, run LIMIT 3) UNION ALL SELECT 'NO-GAIN', run FROM r WHERE kind = 'click' AND n < 5) SELECT rule, run FROM x")
def run_flags(spark: SparkSession, d: str) -> DataFrame:
    """Runs that failed, the three slowest, and those without gain: a union of rules."""
    r = t(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.round(F.sum("value"), 4).alias("elapsed"))
    named = lambda rule, rows: rows.select(F.lit(rule).alias("rule"), "run")
    failed, slow = r.filter("errors > 0 and errors >= 0.25 * n"), r.orderBy(F.desc("elapsed"), "run").limit(3)
    return named("FAILED", failed).unionByName(named("SLOW", slow)).unionByName(named("NO-GAIN", r.filter("clicks > 0 and clicks < 5")))


@query("WITH g AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n IS NULL THEN '0' WHEN n = 1 THEN '1' ELSE 'n' END AS bucket, count(*)::BIGINT AS orders, count(DISTINCT o_custkey)::BIGINT AS customers FROM orders LEFT JOIN g ON o = o_orderkey GROUP BY 1")
def candidate_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = t(spark, d, "orders").join(g, "o_orderkey", "left")
    return o.groupBy(F.when(F.col("n").isNull(), "0").when(F.col("n") == 1, "1").otherwise("n").alias("bucket")).agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@query("WITH m AS (SELECT o_orderpriority AS b, o_orderstatus AS s, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT b, string_agg(s || '=' || round(v)::BIGINT, ' ' ORDER BY s) AS line FROM m GROUP BY b")
def metric_lines(spark: SparkSession, d: str) -> DataFrame:
    """A metric by bucket and label, pivoted and joined to one line a bucket."""
    o = t(spark, d, "orders")
    p = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice")).cast("long"))
    parts = [F.when(F.col(s).isNotNull(), F.concat(F.lit(f"{s}="), F.col(s).cast("string"))) for s in ("F", "O", "P")]
    return p.select(F.col("o_orderpriority").alias("b"), F.concat_ws(" ", *parts).alias("line"))


@query("WITH x AS (SELECT l_shipdate AS ts, l_orderkey AS o, l_linestatus = 'F' AS ok FROM lineitem) SELECT (SELECT arg_max(o, (ts, o)) FROM x WHERE ok) AS last_ok, count(*) FILTER (ok)::BIGINT AS ok, count(*)::BIGINT AS n FROM x")
def last_success(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem")
    ok = F.col("l_linestatus") == "F"
    return x.agg(F.max_by("l_orderkey", F.when(ok, F.struct("l_shipdate", "l_orderkey"))).alias("last_ok"), F.count_if(ok).alias("ok"), F.count("*").alias("n"))


# --- lists -----------------------------------------------------------------------------------------

_LISTS = "m AS (SELECT DISTINCT 'L' || (l_suppkey % 23) AS l, l_partkey AS i FROM lineitem)"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.concat(F.lit("L"), (F.col("l_suppkey") % 23).cast("string")).alias("l"), F.col("l_partkey").alias("i")).distinct()


@query(f"WITH {_LISTS}, tp AS (SELECT p_partkey AS i FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100) SELECT count(DISTINCT l)::BIGINT AS lists, count(DISTINCT i)::BIGINT AS items, (SELECT count(*) FROM tp WHERE i IN (SELECT i FROM m))::BIGINT AS top_covered FROM m")
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    top = t(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select(F.col("p_partkey").alias("i"))
    return lists.corpus_report(_lists(spark, d), top, "l", "i")


@query(f"""WITH {_LISTS}, s AS (SELECT l, count(*) AS n FROM m GROUP BY l), p AS (SELECT a.l AS a, b.l AS b, count(*) AS k FROM m a JOIN m b ON a.i = b.i AND a.l <> b.l GROUP BY ALL),
j AS (SELECT a AS l, max(k / x.n) AS inside, max(k / (x.n + y.n - k)) AS jaccard FROM p JOIN s x ON x.l = a JOIN s y ON y.l = b GROUP BY a), o AS (SELECT l, count(*) AS own FROM (SELECT i, min(l) AS l FROM m GROUP BY i HAVING count(*) = 1) GROUP BY l)
SELECT s.l, round(coalesce(round(inside, 6), 0), 6) AS inside, round(coalesce(round(jaccard, 6), 0), 6) AS jaccard, coalesce(own, 0)::BIGINT AS own, CASE WHEN s.l IN ('L0', 'L7') THEN 'anchor' WHEN coalesce(round(inside, 6), 0) > 0.5 THEN 'subset' WHEN coalesce(round(jaccard, 6), 0) > 0.02 AND coalesce(own, 0) < 20 THEN 'redundant' ELSE 'keep' END AS advice FROM s LEFT JOIN j USING (l) LEFT JOIN o USING (l)""")
def list_advice(spark: SparkSession, d: str) -> DataFrame:
    from stackwright.operators import overlap

    m = _lists(spark, d)
    own = overlap.own_contributions(m, m, "l", "i")
    return lists.advice(m, own, ["L0", "L7"], "l", "i", inside=0.5, alike=0.02, gain=20)


@query("WITH s AS (SELECT n_nationkey AS list_id, 'region_' || n_regionkey AS genre, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS label FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY list_id) AS n FROM s) SELECT genre, list_id, coalesce(label, 'Region ' || substr(genre, 8)) AS label FROM r WHERE n = 1")
def genre_tags(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "nation").select(F.col("n_nationkey").alias("list_id"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("genre"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("label"))
    return lists.genre_tags(s, "genre", "list_id", "label")


@query("WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, n * 97 / sum(n) OVER () AS x FROM s), f AS (SELECT lang, floor(x) AS b, round(x - floor(x), 9) AS r FROM e), p AS (SELECT *, row_number() OVER (ORDER BY r DESC, lang) AS p, 97 - sum(b) OVER () AS short FROM f) SELECT lang, (b + (p <= short)::INT)::BIGINT AS quota FROM p")
def repaired_quotas(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return monitor.repaired_quotas(s, "lang", "n", 97)


@query("WITH q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS n FROM documents), s AS (SELECT lang, floor(count(*) * 0.1 + 0.5) AS quota FROM documents GROUP BY lang) SELECT doc_id, q.lang FROM q JOIN s ON q.lang IS NOT DISTINCT FROM s.lang WHERE n <= quota")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return monitor.sample_quota(t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.1, 42)
