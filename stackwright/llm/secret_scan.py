"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Every text is searched for candidates.  Each candidate's SHA-256 is then counted over the whole corpus by
distinct owners (by default the ``source`` column) and distinct repositories (by default ``source`` with
``lang``).  A value that three owners or more hold is a copied example; one that fewer hold and that looks
random is a live-looking credential.  Candidates of the generic kind ``key`` become spans only if
they are of that second sort; spans of the base kinds always stay.

The text column is read once: the candidates of each row are written to the shared folder, and all counting
works on that narrow table.  Counting goes by (hash, owner, repository), then (hash, owner), then hash, each
with partial sums before its shuffle, so that a secret held by a third of all rows is a few rows a task.

Defined results
---------------
* null text: as the empty text, no spans; base_sha256 is the digest of the empty string.
* null owner or repository: counted as one owner or repository of its own.
* null doc_id and repeated rows: a row each.  Empty table: no rows.
* columns other than doc_id, text and the owner columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# The kinds in their order, their patterns, the group that is the secret, least length.
WORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
KINDS = (
    ("assign", f"({WORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "(AKIA)[A-Z0-9]+", 0, 20),
    ("hex", "([0-9a-f])[0-9a-f]*", 0, 24),
    ("key", "([A-Za-z0-9+/_-])[A-Za-z0-9+/_-]*", 0, 32),
)
# A pattern that every text with a match worth keeping has; cheap to look for.
SIGNS = (f"({WORD})[\"']?\\x20*[:=]", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}", "[A-Za-z0-9+/_-]{32}")
# A match of these is a maximal run of its characters, so shorter runs can be left out at once.
LONG = {"hex": "([0-9a-f]){24,}", "access": "(AKIA)[A-Z0-9]{16,}", "key": "([A-Za-z0-9+/_-]){32,}"}
PLACEHOLDER = "(?i)example|sample|dummy|changeme|your|xxxx|1234567"
DISTINCT_CHARS = 10
COPIED_OWNERS = 3
CANDIDATE = "array<struct<start:int,kind_no:int,kind:string,stop:int,hash:string,live:boolean>>"


def _found(kind_no: int) -> Column:
    """The candidates of one kind, as an array in text order."""
    kind, pattern, group, least = KINDS[kind_no]
    pattern = LONG.get(kind, pattern)
    text, lit = F.col("text"), F.lit(pattern)
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    value = F.regexp_extract_all(text, lit, F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # The gaps and matches by turns give the starts: a running sum of their lengths.
    steps = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), F.transform(whole, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(steps, empty, lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["g"])).alias("starts")))["starts"]
    rows = F.arrays_zip(starts.alias("a"), whole.alias("b"), value.alias("c"))

    def row(x: Column) -> Column:
        start, match, secret = x["0"], x["1"], x["2"]
        chars = F.size(F.array_distinct(F.split(secret, "")))
        live = (chars >= DISTINCT_CHARS) & ~secret.rlike(PLACEHOLDER)
        return F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), (start + F.length(match)).alias("stop"), F.sha2(secret, 256).alias("hash"), live.alias("live"), secret.alias("secret"))

    # Names of the zipped fields are set here, as they depend on the expressions otherwise.
    rows = rows.cast("array<struct<`0`:int,`1`:string,`2`:string>>")
    made = F.filter(F.transform(rows, row), lambda r: F.length(r["secret"]) >= least)
    if kind == "key":
        made = F.filter(made, lambda r: r["secret"].rlike("[A-Z]") & r["secret"].rlike("[a-z]") & r["secret"].rlike("[0-9]"))
    made = F.transform(made, lambda r: F.struct(*(r[c].alias(c) for c in ("start", "kind_no", "kind", "stop", "hash", "live"))))
    sign = F.contains(text, F.lit("AKIA")) & text.rlike(SIGNS[kind_no]) if kind == "access" else text.rlike(SIGNS[kind_no])
    return F.when(sign, made).otherwise(F.array().cast(CANDIDATE)).cast(CANDIDATE)


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, for spans in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def candidates(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row a document: its key, owner, repository and the candidates of all kinds."""
    repo = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in repository))
    small = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), repo.alias("repo"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small = small.select("row", "doc_id", "owner", "repo", *(_found(i).alias(k[0]) for i, k in enumerate(KINDS)))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    small = small.select("row", "doc_id", "owner", "repo", base.alias("base"), "key")
    # A generic key that meets a base span is that span's, not one of its own.
    free = F.filter("key", lambda k: ~F.exists("base", lambda b: (b["start"] < k["stop"]) & (k["start"] < b["stop"])))
    return small.select("row", "doc_id", "owner", "repo", "base", free.alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories: in how many distinct owners and repositories each value stands."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "more")).alias("c")).select("c.hash", "owner", "repo")
    by_owner = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(found: DataFrame) -> DataFrame:
    """The result rows from the stored candidates."""
    n = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{k}")
    head = [F.col("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256")]
    zero = F.lit(0).cast("long")
    has = (F.size("base") > 0) | (F.size("more") > 0)
    none = found.filter(~has).select(*head, F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_copied"), zero.alias("most_owners"))
    some = found.filter(has)
    each = some.select("row", F.explode(F.concat("base", "more")).alias("c")).select("row", "c.*")
    each = each.join(ownership(some), "hash")
    live = F.col("live") & (F.col("owners") < COPIED_OWNERS)
    keep = (F.col("kind") != "key") | live
    span = F.struct("start", "kind_no", "kind", "stop")
    back = each.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(keep, span))).alias("all"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum((F.col("owners") >= COPIED_OWNERS).cast("long")).alias("n_copied"),
        F.max("owners").alias("most_owners"),
    )
    return none.unionByName(some.join(back, "row").select(*head, _joined(F.col("all")).alias("spans"), "n_live", "n_copied", "most_owners"))


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(stored(candidates(table(spark, sf_dir, "documents")), "secret-candidates"))


def _sql() -> str:
    def found(no: int) -> str:
        kind, pattern, group, least = KINDS[no]
        p = LONG.get(kind, pattern).replace("'", "''").replace("\\x20", " ")
        m, g = f"regexp_extract_all(t, '{p}')", f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x))"
        v = f"regexp_extract_all(t, '{p}', {group})"
        return f"""SELECT row, doc_id, owner, repo, {no} AS kind_no, '{kind}' AS kind, g AS gaps, m AS ms, v AS vs, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT *, {g} AS g, {m} AS m, {v} AS v FROM docs)"""

    union = "\n UNION ALL ".join(f"({found(i)})" for i in range(len(KINDS)))
    least = " ".join(f"WHEN '{k[0]}' THEN {k[3]}" for k in KINDS)
    holder = PLACEHOLDER.replace("(?i)", "")
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, concat_ws(chr(31), coalesce(source, chr(30)), coalesce(lang, chr(30))) AS repo, coalesce(text, '') AS t FROM documents),
    raw AS ({union}),
    spots AS (SELECT row, doc_id, owner, repo, kind_no, kind, (list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS start, ms[i] AS m, vs[i] AS v FROM raw),
    good AS (SELECT row, doc_id, owner, repo, kind_no, kind, start, start + length(m) AS stop, sha256(v) AS hash,
             len(list_distinct(string_split(v, ''))) >= {DISTINCT_CHARS} AND NOT regexp_matches(lower(v), '{holder}') AS live
             FROM spots WHERE length(v) >= CASE kind {least} END AND (kind <> 'key' OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))),
    cands AS (SELECT * FROM good g WHERE kind <> 'key' OR NOT EXISTS (SELECT 1 FROM good b WHERE b.row = g.row AND b.kind <> 'key' AND b.start < g.stop AND g.start < b.stop)),
    owned AS (SELECT hash, count(DISTINCT coalesce(owner, chr(30))) AS owners FROM cands GROUP BY hash),
    judged AS (SELECT c.*, o.owners, c.live AND o.owners < {COPIED_OWNERS} AS alive FROM cands c JOIN owned o USING (hash)),
    per AS (SELECT row, sum((kind = 'assign')::INT) AS a, sum((kind = 'access')::INT) AS b, sum((kind = 'hex')::INT) AS h,
            string_agg(CASE WHEN kind <> 'key' THEN kind || ':' || start || ':' || stop END, ',' ORDER BY start, kind_no) AS base,
            string_agg(CASE WHEN kind <> 'key' OR alive THEN kind || ':' || start || ':' || stop END, ',' ORDER BY start, kind_no) AS spans,
            sum(alive::INT) AS n_live, sum((owners >= {COPIED_OWNERS})::INT) AS n_copied, max(owners) AS most_owners FROM judged GROUP BY row)
    SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(most_owners, 0)::BIGINT AS most_owners
    FROM docs LEFT JOIN per USING (row)"""


ORACLE = _sql()
