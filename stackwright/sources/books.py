"""Readers of book records: shards in order, list pages, nested documents, state files, telemetry, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import text as tx

from .records import json_records, zipped

#: What a page record must hold.
PAGE = "book_urls array<string>, titles array<string>, authors array<string>, rating_texts array<string>, score_texts array<string>, vote_texts array<string>"
RECORD = "legacy_id string, isbn13 string, title string, author string, ratings_count string, _scrape_warning string, _url string, _attempt_count string"


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, at): lines of many shards; ``at`` sorts by the file's time, its name, and the place in it.

    A line's place follows from the order in which Spark numbers a file's rows: numbers rise within a task, and a
    task reads stretches of a file in order.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row_"))
    at = F.struct(F.col("file_modification_time").alias("time"), F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.col("row_").alias("row"))
    return raw.select("value", F.col("file_path").alias("file"), at.alias("at"))


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of a path, or no rows of the same schema where there is no such path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; a line that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def list_pages(raw: DataFrame, arrays: list[str], pattern: str = r"(\d+)\.jsonl") -> DataFrame:
    """Rows of the pages of all lists, with list_id from the file's name; arrays are cut to the shortest of ``arrays``."""
    pages = json_records(raw, PAGE).withColumn("list_id", F.regexp_extract("file", pattern, 1).try_cast("bigint"))
    return zipped(pages.select("list_id", *arrays), arrays)


def missing_fields(raw: DataFrame, fields: list[str]) -> DataFrame:
    """(file, missing): files whose first line, by ``at``, lacks a field."""
    first = raw.groupBy("file").agg(F.min_by("value", "at").alias("value"))
    gone = F.array_except(F.array(*map(F.lit, fields)), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    return first.select("file", F.array_sort(gone).alias("missing")).filter(F.size("missing") > 0)


def succeeded(records: DataFrame) -> DataFrame:
    """Distinct ids of records that carry one."""
    return records.select(F.col("legacy_id").try_cast("bigint").alias("id")).filter("id is not null").distinct()


def warned(records: DataFrame) -> DataFrame:
    """(id, attempts): warnings by the id in their address; a merged record counts its attempts."""
    id_ = tx.path_id("_url")
    n = F.coalesce(F.col("_attempt_count").try_cast("bigint"), F.lit(1))
    return records.filter("_scrape_warning is not null").select(id_.alias("id"), n.alias("n")).filter("id is not null").groupBy("id").agg(F.sum("n").alias("attempts"))


def last_isbns(records: DataFrame) -> DataFrame:
    """(id, isbn13): the last valid number of each id by ``at``."""
    good = records.select(F.col("legacy_id").try_cast("bigint").alias("id"), tx.isbn13("isbn13").alias("isbn13"), "at").filter("id is not null and isbn13 is not null")
    return good.groupBy("id").agg(F.max_by("isbn13", "at").alias("isbn13"))


def full_records(records: DataFrame) -> DataFrame:
    """The last record of each id that has a number, a title and an author, with typed counts."""
    typed = records.select(F.col("legacy_id").try_cast("bigint").alias("id"), tx.isbn13("isbn13").alias("isbn13"), F.trim("title").alias("title"), F.trim("author").alias("author"), F.col("ratings_count").try_cast("bigint").alias("ratings"), "at")
    good = typed.filter("id is not null and isbn13 is not null and title <> '' and author <> ''")
    return good.groupBy("id").agg(F.max_by(F.struct("isbn13", "title", "author", "ratings"), "at").alias("r")).select("id", "r.*", F.lit(0).alias("appearances"))


def last_or_accumulated(records: DataFrame) -> DataFrame:
    """(key, kind, attempts): the last success of each id, and each warned address with all its attempts."""
    ok = records.filter(F.col("legacy_id").try_cast("bigint").isNotNull()).groupBy(F.col("legacy_id").try_cast("bigint").alias("id")).agg(F.lit(1).alias("attempts"))
    bad = warned(records).join(ok.select("id"), "id", "left_anti")
    return ok.select("id", F.lit("success").alias("kind"), F.col("attempts").cast("long").alias("attempts")).unionByName(bad.select("id", F.lit("warning").alias("kind"), "attempts"))


def state_file(raw: DataFrame, name: str, fields: str, value: str = "value") -> DataFrame:
    """Rows (id, fields) of a JSON object that maps ids to objects below ``name``; malformed files have none."""
    parsed = raw.select(F.from_json(value, f"{name} map<string, struct<{fields}>>").alias("r")).select(F.explode(F.col("r").getField(name)).alias("key", "v"))
    return parsed.select(F.col("key").try_cast("bigint").alias("id"), "v.*").filter("id is not null")


def as_state_file(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One JSON line that maps each key to an object of the other columns; for state of bounded size."""
    rest = [c for c in rows.columns if c != key]
    entry = F.struct(F.col(key).cast("string").alias("k"), F.struct(*rest).alias("v"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name)).select(F.to_json(F.struct(name)).alias("value"))


def nested_json(column: Column, prefix: str) -> Column:
    """The JSON of the first entry, by key, of a JSON object whose key begins with ``prefix``."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    return F.array_sort(F.filter(entries, lambda e: e["key"].startswith(prefix)))[0]["value"]


def embedded_json(html: Column) -> Column:
    """The document that a page holds in its data script; null without one."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def search_rows(html: Column, most: int = 8) -> Column:
    """(id, title) of the first distinct books of a result table."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr.*?</tr>"), F.lit(0))
    one = lambda r: F.struct(F.regexp_extract(r, r"/book/show/(\d+)", 1).try_cast("bigint").alias("id"), F.regexp_extract(r, r"title=\"([^\"]*)\"", 1).alias("title"))
    return F.slice(F.array_distinct(F.filter(F.transform(rows, one), lambda b: b["id"].isNotNull())), 1, most)


def telemetry(raw: DataFrame, schema: str) -> DataFrame:
    """Runs of newline-parted JSON; other lines are skipped."""
    return json_records(raw, schema)


def spine_rows(runs: DataFrame, scene: str | None = None) -> DataFrame:
    """A row for each spine of each run, with defaults for absent fields."""
    if scene:
        runs = runs.filter(F.col("scene") == scene)
    s = runs.select("run_id", "scene", F.posexplode("spines").alias("place", "s"))
    return s.select("run_id", "scene", F.col("place").cast("long").alias("place"), F.coalesce("s.decision", F.lit("none")).alias("decision"), F.coalesce("s.score", F.lit(0.0)).alias("score"), F.coalesce(F.size("s.candidates"), F.lit(0)).cast("long").alias("candidates"))


def volumes(raw: DataFrame, value: str = "value") -> DataFrame:
    """(query, place, title, authors) of a JSON object that maps queries to lists of volumes; blank titles drop out."""
    kind = "map<string, array<struct<volumeInfo: struct<title: string, authors: array<string>>>>>"
    each = raw.select(F.explode(F.from_json(value, kind)).alias("query", "vs")).select("query", F.posexplode("vs").alias("place", "v"))
    return each.select("query", F.col("place").cast("long").alias("place"), F.trim("v.volumeInfo.title").alias("title"), F.coalesce("v.volumeInfo.authors", F.array().cast("array<string>")).alias("authors")).filter("title <> ''")


def detections(raw: DataFrame, value: str = "value") -> DataFrame:
    """(file, id, conf) of detection files in either layout: a list below ``detections`` or below ``result.boxes``."""
    kind = "detections array<struct<id: bigint, conf: double>>, result struct<boxes: array<struct<id: bigint, conf: double>>>"
    r = raw.select("file", F.from_json(value, kind).alias("r")).select("file", F.coalesce("r.detections", "r.result.boxes").alias("boxes"))
    return r.select("file", F.explode("boxes").alias("b")).select("file", "b.id", "b.conf")


def first_names(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an order column."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r_")).select(*keys, *(F.col(f"r_.{c}").alias(c) for c in rest))


def author_refs(authors: Column) -> Column:
    """Keys, in order, of author references in either shape: ``{key}`` or ``{author: {key}}``."""
    both = F.from_json(authors, "array<struct<key: string, author: struct<key: string>>>")
    return F.filter(F.transform(both, lambda a: F.coalesce(a["key"], a["author"]["key"])), lambda k: k.isNotNull())


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_code(code: Column) -> Column:
    """Trimmed, in lower case, without a path before it; blank is null."""
    return F.nullif(F.substring_index(F.lower(F.trim(code)), "/", -1), F.lit(""))
