"""Token retrieval: postings, passes, BM25 and verification after the limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most (query, token) pairs, and most cells of a matrix, that a task holds when it scores documents itself.
PAIRS, CELLS = 1_000_000, 8_000_000


def postings(docs: DataFrame, doc: str, words: str) -> DataFrame:
    """(token, doc, tf, length): a row for each distinct token of a document."""
    sized = docs.select(F.col(doc), F.size(words).alias("length"), F.explode(words).alias("token"))
    return sized.groupBy("token", doc, "length").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, index: DataFrame, query: str, doc: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score, hits) for documents that share a token with a query; queries: (query, token).

    Only postings of asked tokens are scored.  Counts per token come from the same index.
    """
    sizes = index.select(doc, "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = queries.select(query, "token").distinct()
    df = index.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    hit = asked.join(df, "token").join(index, "token").crossJoin(F.broadcast(sizes))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hit.groupBy(query, doc).agg(F.sum(part).alias("score"), F.count("*").alias("hits"))


def best_documents(docs: DataFrame, queries: DataFrame, query: str, doc: str, text: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score, hits, rank): the k best documents a query by BM25; ties by doc.

    ``text`` is blank-parted words; queries: (query, token).  Up to ``PAIRS`` query tokens, each task scores its own
    documents for all queries at once and sends its k best a query, so that no row is made for a word that a
    document and a query share.  Beyond that postings are joined.
    """
    asked = queries.select(F.col(query).cast("long").alias("q"), "token").distinct()
    pairs = asked.limit(PAIRS + 1).toArrow()
    if len(pairs) > PAIRS:
        words = docs.select(doc, F.split(text, " ").alias("w_"))
        return top_per_query(bm25(queries, postings(words, doc, "w_"), query, doc, k1, b), query, doc, "score", k)
    tokens = pc.unique(pairs.column("token").combine_chunks())
    names = np.unique(pairs.column("q").to_numpy())
    at = (pc.index_in(pairs.column("token").combine_chunks(), value_set=tokens).to_numpy(), np.searchsorted(names, pairs.column("q").to_numpy()))
    narrow = docs.select(F.col(doc).cast("long").alias(doc), text)

    def counted(texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Of the documents of a batch: lengths, and (document, token, times) of asked tokens."""
        parts = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), " ")
        size = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        which = pc.index_in(parts.flatten(), value_set=tokens).fill_null(-1).to_numpy()
        pair, times = np.unique((np.repeat(np.arange(len(size)), size) * len(tokens) + which)[which >= 0], return_counts=True)
        return size, *np.divmod(pair, max(1, len(tokens))), times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens) + 2, np.int64)  # documents a token, then documents and words
        for batch in batches:
            size, _, token, _ = counted(batch.column(1))
            total += np.append(np.bincount(token, minlength=len(tokens)), [len(size), size.sum()])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["i", "n"])

    sums = narrow.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(tokens) + 2, np.int64)
    total[sums.column("i").to_numpy()] = sums.column("n").to_numpy()
    df, n, mean = total[:-2], int(total[-2]), total[-1] / max(1, total[-2])
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("q", pa.int64()), ("doc", pa.int64()), ("score", pa.float64()), ("hits", pa.int64())]
        wide = max(1, CELLS // max(1, len(tokens)))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            size, row, token, times = counted(batch.column(1))
            weight = idf[token] * times * (k1 + 1) / (times + k1 * (1 - b + b * size[row] / mean))
            for first in range(0, len(names), wide):  # queries in blocks, so that the matrix is bounded
                own = (at[1] >= first) & (at[1] < first + wide)
                has = np.zeros((len(tokens), min(wide, len(names) - first)))
                has[at[0][own], at[1][own] - first] = 1
                scores, hits = np.zeros((len(ids), has.shape[1])), np.zeros((len(ids), has.shape[1]))
                for r in range(0, len(ids), wide):
                    some = (row >= r) & (row < r + wide)
                    m = np.zeros((min(wide, len(ids) - r), len(tokens)))
                    m[row[some] - r, token[some]] = weight[some]
                    scores[r : r + wide] = m @ has
                    hits[r : r + wide] = (m != 0) @ has
                out = []
                for j in range(has.shape[1]):
                    found = np.flatnonzero(hits[:, j])
                    best = found[np.lexsort((ids[found], -np.round(scores[found, j], 6)))[:k]]
                    out.append((np.full(len(best), names[first + j]), ids[best], scores[best, j], hits[best, j].astype(np.int64)))
                cols = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], [c for c, _ in kinds])

    found = narrow.filter(F.col(doc).isNotNull()).mapInArrow(score, "q long, doc long, score double, hits long")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 6)), "doc")
    top = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(F.col("q").alias(query), F.col("doc").alias(doc), "score", "hits", "rank")


def top_per_query(scored: DataFrame, query: str, doc: str, score: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(score), doc)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merged_passes(passes: list[tuple[str, DataFrame]], query: str, doc: str, cap: int) -> DataFrame:
    """Passes of ranked rows: each document's best rank and the first pass that gave it, capped a query."""
    out = None
    for i, (name, p) in enumerate(passes):
        p = p.select(query, doc, "rank", F.lit(i).alias("pass_no"), F.lit(name).alias("pass"))
        out = p if out is None else out.unionByName(p)
    best = out.groupBy(query, doc).agg(F.min(F.struct("rank", "pass_no", "pass")).alias("b"))
    w = Window.partitionBy(query).orderBy("b.rank", "b.pass_no", doc)
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).select(query, doc, F.col("b.rank").alias("rank"), F.col("b.pass").alias("pass"), "place")


def contains_join(docs: DataFrame, phrases: DataFrame, doc: str, text: str, phrase_id: str, phrase: str, least: int = 4) -> DataFrame:
    """Documents that hold a phrase of at least ``least`` words as it is.

    A phrase is probed by its longest word, which every document that holds it has too; then it is verified.
    Only candidate pairs meet the texts.
    """
    words = lambda c: F.split(F.col(c), " ")
    longest = F.array_sort(F.transform(words(phrase), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    probe = phrases.filter(F.size(words(phrase)) >= least).select(phrase_id, phrase, longest.alias("word_"))
    index = docs.select(doc, F.explode(F.array_distinct(words(text))).alias("word_"))
    pairs = index.join(probe, "word_").select(doc, phrase_id, phrase)
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return pairs.join(docs.select(doc, text), doc).filter(F.contains(padded(text), padded(phrase))).select(doc, phrase_id).distinct()
