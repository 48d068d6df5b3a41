"""Readers of line-oriented records: JSON lines, tab-separated dumps, pages of parallel arrays, CSV, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of every line; gzip files are read as they are."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"))


def json_records(raw: DataFrame, schema: StructType | str, value: str = "value") -> DataFrame:
    """Typed records of the lines that are JSON objects; other lines are skipped."""
    good = raw.filter(F.expr(f"is_variant_null(try_parse_json({value})) = false and schema_of_variant(try_parse_json({value})) like 'OBJECT%'"))
    return good.select(*(c for c in raw.columns if c != value), F.from_json(value, schema).alias("r")).select(*(c for c in raw.columns if c != value), "r.*")


def dump_records(raw: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """A bare JSON object, or ``type, key, revision, time, json`` parted by tabs; shorter lines drop out.

    The key stands in the JSON or in the line; the type is that of the line.
    """
    v = F.col(value)
    bare = F.ltrim(v).startswith("{")
    parts = F.split(v, "\t", 5)
    body = F.when(bare, v).when(F.size(parts) == 5, parts[4])
    typed = raw.select(body.alias("body_"), F.when(~bare, F.try_element_at(parts, F.lit(1))).alias("type"), F.when(~bare, F.try_element_at(parts, F.lit(2))).alias("key_")).filter(F.col("body_").isNotNull() & F.expr("try_parse_json(body_) is not null"))
    out = typed.select("type", "key_", F.from_json("body_", schema).alias("r"))
    return out.select("type", F.coalesce("r.key", "key_").alias("key"), *(F.col(f"r.{f.split()[0]}") for f in schema.split(", ") if f.split()[0] != "key"))


def zipped(pages: DataFrame, arrays: list[str]) -> DataFrame:
    """A row for each place of parallel arrays, up to the shortest; other columns stay."""
    n = F.least(*(F.size(F.coalesce(c, F.array())) for c in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    cut = F.arrays_zip(*(F.slice(F.col(c), F.lit(1), n).alias(c) for c in arrays))
    rest = [c for c in pages.columns if c not in arrays]
    return pages.filter(n > 0).select(*rest, F.explode(cut).alias("z_")).select(*rest, *(F.col("z_").getField(c).alias(c) for c in arrays))


def require_fields(raw: DataFrame, fields: list[str], value: str = "value", order: Column | None = None) -> DataFrame:
    """(file, missing): files whose first line lacks a field; an empty result is a pass.

    ``order`` says which line is first; without it, it is the place in the task that read the file.
    """
    first = raw.withColumn("order_", F.monotonically_increasing_id() if order is None else order).groupBy("file").agg(F.min_by(value, "order_").alias(value))
    missing = F.array_except(F.array(*map(F.lit, fields)), F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")))
    return first.select("file", missing.alias("missing")).filter(F.size("missing") > 0)


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """title, author, isbn, workkey: header in any case, quotes and line breaks in fields, blanks to null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    named = raw.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().lower()) for c in raw.columns))
    for c in ("isbn", "workkey"):
        if c not in named.columns:
            named = named.withColumn(c, F.lit(None).cast("string"))
    return named.filter("title is not null and author is not null").select("title", "author", "isbn", "workkey")


def ids(raw: DataFrame, value: str = "value") -> DataFrame:
    """Distinct whole numbers, one a line; other lines are skipped."""
    return raw.select(F.trim(value).try_cast("bigint").alias("id")).filter("id is not null").distinct()


def quads(raw: DataFrame, width: float, height: float, value: str = "value") -> DataFrame:
    """(file, class, points): ``class x1 y1 .. x4 y4`` in shares of the picture, as pixels."""
    parts = F.split(F.trim(value), r"\s+")
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.get(parts, i * 2 + 1).try_cast("double") * width).alias("x"), (F.get(parts, i * 2 + 2).try_cast("double") * height).alias("y")))
    out = raw.filter(F.size(parts) == 9).select("file", parts[0].try_cast("int").alias("class"), points.alias("points"))
    return out.filter(F.col("class").isNotNull() & F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))


def newest_files(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n most recently changed files below a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.orderBy(F.desc("modificationTime"), "path").limit(n)
