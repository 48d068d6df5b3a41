"""Building a ranked catalog from records of editions, works and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackwright.functions import text as tx


def edition_stats(editions: DataFrame, work: str, isbn: str | None = None, language: str | None = None) -> DataFrame:
    """Per work: edition_count, distinct languages and distinct numbers, sorted."""
    aggs = [F.count("*").alias("edition_count")]
    if language:
        aggs.append(F.array_sort(F.collect_set(language)).alias("languages"))
    if isbn:
        aggs += [F.array_sort(F.collect_set(isbn)).alias("isbns"), F.min(isbn).alias("isbn13")]
    return editions.filter(F.col(work).isNotNull()).groupBy(work).agg(*aggs)


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an explicit order column; one aggregate, no window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r_")).select(key, *(F.col(f"r_.{c}").alias(c) for c in rest))


def joined_names(links: DataFrame, names: DataFrame, work: str, author: str, order: str, name: str) -> DataFrame:
    """(work, author): names in link order, joined as prose; links without a name drop out."""
    found = links.join(names, author).filter(F.length(F.trim(name)) > 0)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name])
    return found.groupBy(work).agg(tx.join_names(ordered).alias("author"))


def bucketed(rows: DataFrame, order: list, buckets: int | None = None) -> DataFrame:
    """``rows`` with ``order_`` (the order as a struct) and ``bucket_``, a number that rises with it.

    The bounds are quantiles of a bounded sample (64 rows a bucket, those with the smallest hashes), held as
    one array in one row.  A row's bucket depends on its values and the sample alone, never on how rows are
    dealt over tasks, so that the frame may be planned any number of times.
    """
    n = buckets or max(8, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = [c.alias(f"o{i}") for i, c in enumerate(F.col(c) if isinstance(c, str) else c for c in order)]
    keyed = rows.withColumn("order_", F.struct(*named))
    sample = keyed.select("order_", F.xxhash64("order_").alias("h_")).orderBy("h_", "order_").limit(64 * n).agg(F.array_sort(F.collect_list("order_")).alias("s_"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("s_", F.floor(i * F.size("s_") / n).cast("int")))
    bounds = sample.select(F.filter(steps, lambda x: x.isNotNull()).alias("bounds_"))
    # Binary search: the number of bounds below the row.
    size = F.size("bounds_")

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["a"] + at["b"]) / 2).cast("int")
        above = F.get("bounds_", mid) < F.col("order_")
        return F.when(at["a"] >= at["b"], at).when(above, F.struct((mid + 1).alias("a"), at["b"].alias("b"))).otherwise(F.struct(at["a"].alias("a"), mid.alias("b")))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), F.struct(F.lit(0).alias("a"), size.alias("b")), halve)
    return keyed.join(F.broadcast(bounds)).withColumn("bucket_", found["a"]).drop("bounds_")


def running_totals(rows: DataFrame, order: list, weight: Column, total: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over all rows before theirs in a total order, as ``total``.

    Each bucket's sum is added up before it (a row a bucket), and each bucket sums its own rows: no window
    goes over the whole table.
    """
    placed = bucketed(rows.withColumn("weight_", weight), order)
    sums = placed.groupBy("bucket_").agg(F.sum("weight_").alias("n_"))
    up_to = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = sums.select("bucket_", zero(F.sum("n_").over(up_to.orderBy("bucket_"))).alias("before_"))
    own = zero(F.sum("weight_").over(up_to.partitionBy("bucket_").orderBy("order_")))
    return placed.withColumn("own_", own).join(F.broadcast(before), "bucket_", "left").withColumn(total, F.col("own_") + F.col("before_")).select(*rows.columns, total)


def ranked(works: DataFrame, key: str, count: str, rank: str = "popularity_rank") -> DataFrame:
    """A global rank 1..n by falling count (null first), then key, without sorting everything in one task."""
    return running_totals(works, [-F.col(count), F.col(key)], F.lit(1), rank).withColumn(rank, F.col(rank) + 1)


def dedupe_then_cap(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first row of each key, then the first ``most`` rows: a duplicate takes no place under the cap."""
    first = rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("n_ = 1").drop("n_")
    return first.orderBy(*order).limit(most)


def top_with_ties(counts: DataFrame, value: str, key: str, k: int, most: int) -> DataFrame:
    """The k largest and all that tie with the k-th, at most ``most`` rows; a sorted limit, no global window."""
    head = counts.orderBy(F.desc(value), key).limit(most)
    bound = head.orderBy(F.desc(value), key).limit(k).agg(F.min(value).alias("bound_"))
    return head.crossJoin(F.broadcast(bound)).filter(F.col(value) >= F.col("bound_")).drop("bound_")


def isbn_works(index: DataFrame, shipped: DataFrame, isbn: str, work: str) -> DataFrame:
    """Distinct valid (isbn, work) rows whose work is shipped."""
    return index.join(shipped.select(work).distinct(), work, "left_semi").filter(tx.isbn13_ok(isbn)).select(isbn, work).distinct()


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old and new rows by key; of both, the new row's ``columns`` win."""
    a, b = old.alias("a"), new.alias("b")
    out = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    for c in old.columns:
        if c != key:
            out.append((F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in columns else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and the new ones whose key is not there; a key once."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def last_success(records: DataFrame, key: str, order: str, ok: str, isbn: str) -> DataFrame:
    """An order-dependent fold: a success overwrites; an incomplete record only where no number is known.

    An incomplete record is ignored if the latest success before it has a number; of the others the last wins.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col(ok), F.col(isbn).isNotNull()), ignorenulls=True).over(w)
    kept = records.withColumn("known_", F.coalesce(known, F.lit(False))).filter(F.col(ok) | ~F.col("known_")).drop("known_")
    return keep_last(kept, key, order)
