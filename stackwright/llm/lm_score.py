"""Stupid-backoff scores of documents by tables of the whole corpus's n-grams, up to ``order`` words.

Each document is scored by the counts of all other documents (its own are taken off), so that a document
does not vouch for itself.  With c for such counts, N for the words of the other documents and backoff 0.4:

    score(w | v) = c(v w) / c(v)        where c(v w) > 0
                 = 0.4 c(w) / N         else, where c(w) > 0
                 = 0.4 * 0.4 / (N + 1)  else

and the first word has c(w) / N or 0.4 / (N + 1).  That is order 2; each further order puts one case before
these for words with n - 1 others before them in the document, and 0.4 times the shorter context's score else:

    score(w | u v) = c(u v w) / c(u v)  where c(u v w) > 0

Logarithms (base 10) are summed per document.

Counts are rows of DataFrames: a batch of documents is exploded into a row for each distinct n-gram (hash, batch,
count there), the rows are dealt by hash, summed to count tables, and joined back to the tables; a batch gets the
totals of those of its n-grams that other batches hold too.  Any other total is the batch's own count.  An n-gram of
two words or more can stand in another batch only if the two shorter ones that it ends and begins with do, so
that only such are exploded: that drops no count.  An n-gram that is everywhere is a row a batch, so no key is hot,
and a batch sends a row to those parts only that it has n-grams for.

The n-grams are worked off length by length in slices by their hash, one after another, so that only a slice's
rows are on disk at a time.  What a slice leaves are the counts at the words of a batch, in a file, without hashes; the batch's
documents are scored from these and summed.  Batches and counts are written to files in the shared folder, named
only by the rows of the attempt that wrote them, and read back by range.

Defined results
---------------
* null or blank text: no words, log_score 0, mean_log null.  Null doc_id: scored as any other.
* repeated rows: each is a document, and counts for the others.  Empty table: no rows.
* words are parted at 0x20 and 0x09-0x0D, A-Z in lower case; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import opened, released, scratch, shuffles_freed, stored, table

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BACKOFF = 0.4
ORDER = 3
BATCH_CHARS = 10_000_000
PART_ROWS = 4_000_000
SLICES = 4
U = np.uint64
BATCH = "batch long, words long, file string, at long, parts array<long>"
COUNTS = "batch long, length int, slice int, file string, width int"
ASKED = "gram long, batch long, n long"
RESULT = "doc_id long, n_words long, log_score double, mean_log double"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def slices(length: int) -> int:
    """Slices of a length: words alone are fewer rows than longer n-grams."""
    return SLICES // 2 if length == 1 else SLICES


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def _batches(docs: DataFrame, folder: str) -> DataFrame:
    """Writes packed documents below ``folder``; a row a batch, with its file, place and the parts' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, press = Hashes(), zstandard.ZstdCompressor(level=3)
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        name, out, at = uuid.uuid4().hex, None, 0

        def packed(ids: list, texts: list) -> pa.RecordBatch:
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}")
            words = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in ((t or "").encode().translate(LOWER).split() for t in texts)]
            sizes = np.array([len(w) for w in words], np.uint32)
            distinct, places = np.unique(np.concatenate(words), return_inverse=True)
            null = np.array([i is None for i in ids], np.uint8)
            ids = np.array([i or 0 for i in ids], np.int64)
            blobs = [press.compress(x.tobytes()) for x in (ids, null, sizes, distinct, places.astype(np.uint32))]
            number = xxhash.xxh3_64_intdigest(f"{name}-{at}") >> 1
            row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(sizes.sum())]), pa.array([name]), pa.array([at]), pa.array([[len(b) for b in blobs]], pa.list_(pa.int64()))], ["batch", "words", "file", "at", "parts"])
            for b in blobs:
                out.write(b)
                at += len(b)
            return row

        ids, texts, chars, rows = [], [], 0, []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                chars += len(t or "")
                if chars >= BATCH_CHARS or len(ids) >= 50_000:
                    rows.append(packed(ids, texts))
                    ids, texts, chars = [], [], 0
        if ids:
            rows.append(packed(ids, texts))
        if out is not None:
            out.close()
        yield from rows

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BATCH)


class Batch:
    """A batch's documents, its words' places, and its n-grams by length and slice."""

    def __init__(self, folder: str, row: dict) -> None:
        self.fs, self.base = opened(folder)
        with self.fs.open_input_file(f"{self.base}/{row['file']}") as file:
            file.seek(row["at"])
            blobs = [zstandard.decompress(file.read(n)) for n in row["parts"]]
        self.batch, self.counted = row["batch"], row.get("counted") or []
        self.ids = np.frombuffer(blobs[0], np.int64)
        self.null = np.frombuffer(blobs[1], np.uint8) > 0
        self.sizes = np.frombuffer(blobs[2], np.uint32).astype(np.int64)
        self.words, self.places = np.frombuffer(blobs[3], np.uint64), np.frombuffer(blobs[4], np.uint32)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions of the last words of n-grams, and the n-grams' hashes."""
        if length == 1:
            return np.arange(len(self.places)), _mix(self.words ^ U(0x5851F42D4C957F2D))[self.places]
        gram = h = self.words[self.places]
        nth = np.arange(len(h)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        for n in range(2, length + 1):
            after = np.flatnonzero(nth >= n - 1)
            whole = np.zeros(len(h), np.uint64)
            whole[after] = _mix(_mix(gram[after - 1] + U(n - 1)) + h[after])
            gram = whole
        return after, gram[after]

    def rows(self, length: int, part: int) -> pa.Table:
        """Rows of the n-grams of a length and slice; of two words or more only of those whose beginning and end
        other batches hold."""
        after, whole = self.grams(length)
        keep = whole % U(slices(length)) == part
        if length > 1:
            shared = self.counts(length - 1) & 1 > 0
            keep &= shared[after] & shared[after - 1]
        keys, counts = np.unique(whole[keep], return_counts=True)
        return pa.table({"gram": keys.view(np.int64), "batch": np.full(len(keys), self.batch), "n": counts})

    def count(self, length: int, part: int, grams: np.ndarray, totals: np.ndarray) -> dict:
        """Writes, for each position of a length and slice, twice the n-gram's count in all other documents, and one
        more if other batches hold it; ``grams`` are sorted and hold those that do, with their totals."""
        after, whole = self.grams(length)
        pick = whole % U(slices(length)) == part
        keys, at = np.unique(whole[pick], return_inverse=True)
        total, known = np.bincount(at, minlength=len(keys)), np.zeros(len(keys), bool)
        if len(grams):
            place = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
            known = grams[place] == keys
            total = np.where(known, totals[place], total)
        _, back, own = np.unique(self.doc[after[pick]] * np.int64(max(1, len(keys))) + at, return_inverse=True, return_counts=True)
        found = (total[at] - own[back]) * 2 + known[at]
        found = found.astype(np.min_scalar_type(int(found.max(initial=0))))
        name = f"counts-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(f"{self.base}/{name}") as out:
            out.write(zstandard.compress(found.tobytes()))
        return {"batch": self.batch, "length": length, "slice": part, "file": name, "width": found.itemsize}

    def counts(self, length: int) -> np.ndarray:
        """What ``count`` has written of a length, by position; 0 where no n-gram ends."""
        after, whole = self.grams(length)
        out = np.zeros(len(self.places), np.int64)
        for row in self.counted:
            if row["length"] == length:
                with self.fs.open_input_file(f"{self.base}/{row['file']}") as file:
                    out[after[whole % U(slices(length)) == row["slice"]]] = np.frombuffer(zstandard.decompress(file.read()), f"u{row['width']}")
        return out

    def scores(self, corpus: int, order: int) -> np.ndarray:
        """The summed logarithms of each document."""
        one = self.counts(1) >> 1
        rest = (corpus - self.sizes)[self.doc].astype(np.float64)
        log = np.where(one > 0, np.log10(np.maximum(one, 1)) - np.log10(np.maximum(rest, 1)), np.log10(BACKOFF) - np.log10(rest + 1))
        shorter = one
        for n in range(2, order + 1):
            after, found = self.grams(n)[0], self.counts(n) >> 1
            seen = np.log10(np.maximum(found[after], 1)) - np.log10(np.maximum(shorter[after - 1], 1))
            log[after] = np.where(found[after] > 0, seen, log[after] + np.log10(BACKOFF))
            shorter = found
        return np.bincount(self.doc, weights=log, minlength=len(self.ids))


def shared_counts(asked: DataFrame, parts: int) -> DataFrame:
    """(batch, gram, total) of the n-grams that more than one batch holds, from rows (gram, batch, n).

    Rows are dealt by n-gram once; each row meets its n-gram's sum there.  A sum over a window is the count table
    and its join in one sort: as two plans, Spark would make and deal the rows twice.
    """
    w = Window.partitionBy("gram")
    each = asked.repartition(parts, "gram").select("batch", "gram", F.sum("n").over(w).alias("total"), F.count("*").over(w).alias("holders"))
    return each.filter("holders > 1").select("batch", "gram", "total")


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score and mean_log for each row of ``docs``, by contexts of up to order - 1 words."""
    spark = docs.sparkSession
    folder = scratch(spark, "lm-batches")
    held = stored(_batches(docs, folder), "lm-index")
    corpus, batches = held.agg(F.sum("words"), F.count("*")).first()
    corpus = corpus or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, corpus // (PART_ROWS * SLICES) + 1)
    counted = None

    def spread() -> DataFrame:
        """A row a batch, with the counts written so far."""
        if counted is None:
            return held.repartition(max(least, batches or 1), "batch")
        files = counted.groupBy("batch").agg(F.collect_list(F.struct("length", "slice", "file", "width")).alias("counted"))
        return held.join(files, "batch", "left").repartition(max(least, batches or 1), "batch")

    def slice_of(length: int, part: int) -> DataFrame:
        def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in rows:
                for row in some.to_pylist():
                    yield from Batch(folder, row).rows(length, part).to_batches(200_000)

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            grams, totals = right.column("gram").to_numpy().view(U), right.column("total").to_numpy()
            by = np.argsort(grams)
            grams, totals = grams[by], totals[by]
            found = [Batch(folder, row).count(length, part, grams, totals) for row in left.to_pylist()]
            ints = {"batch": pa.int64(), "length": pa.int32(), "slice": pa.int32(), "file": pa.string(), "width": pa.int32()}
            return pa.table({k: pa.array([f[k] for f in found], t) for k, t in ints.items()})

        totals = shared_counts(spread().mapInArrow(ask, ASKED), parts)
        return held.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(answer, COUNTS)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for row in some.to_pylist():
                b = Batch(folder, row)
                logs = b.scores(corpus, order)
                mean = np.round(logs / np.maximum(b.sizes, 1), 6)
                cols = [pa.array(b.ids, pa.int64(), mask=b.null), pa.array(b.sizes, pa.int64()), pa.array(np.round(logs, 4), pa.float64()), pa.array(mean, pa.float64(), mask=b.sizes == 0)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "log_score", "mean_log"])

    for length in range(1, order + 1):
        done = []
        for part in range(slices(length)):
            with shuffles_freed(spark):
                done.append(stored(slice_of(length, part), "lm-counts"))
            released(spark)
        for one in done:
            counted = one if counted is None else counted.unionByName(one)
    return spread().mapInArrow(finish, RESULT)


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


# Order 3; u, v, w are the words before and the word itself, each count less the document's own.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d),
p AS (SELECT r, i, n, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM t),
n_all AS (SELECT count(*) AS n FROM t),
a AS (SELECT w, count(*) AS c FROM t GROUP BY w), ad AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
b AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w), bd AS (SELECT r, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY r, v, w),
e AS (SELECT u, v, w, count(*) AS c FROM p WHERE u IS NOT NULL GROUP BY u, v, w), ed AS (SELECT r, u, v, w, count(*) AS c FROM p WHERE u IS NOT NULL GROUP BY r, u, v, w),
x AS (SELECT p.r, p.n, p.u, p.v, a.c - ad.c AS cw, av.c - avd.c AS cv, b.c - bd.c AS cvw, bu.c - bud.c AS cuv, e.c - ed.c AS cuvw, (SELECT n FROM n_all) - p.n AS rest
      FROM p JOIN a ON a.w = p.w JOIN ad ON ad.r = p.r AND ad.w = p.w LEFT JOIN a av ON av.w = p.v LEFT JOIN ad avd ON avd.r = p.r AND avd.w = p.v
      LEFT JOIN b ON b.v = p.v AND b.w = p.w LEFT JOIN bd ON bd.r = p.r AND bd.v = p.v AND bd.w = p.w
      LEFT JOIN b bu ON bu.v = p.u AND bu.w = p.v LEFT JOIN bd bud ON bud.r = p.r AND bud.v = p.u AND bud.w = p.v
      LEFT JOIN e ON e.u = p.u AND e.v = p.v AND e.w = p.w LEFT JOIN ed ON ed.r = p.r AND ed.u = p.u AND ed.v = p.v AND ed.w = p.w),
l AS (SELECT r, CASE WHEN u IS NOT NULL AND cuvw > 0 THEN log10(cuvw) - log10(cuv)
      ELSE CASE WHEN u IS NULL THEN 0 ELSE log10({BACKOFF}) END + CASE WHEN v IS NOT NULL AND cvw > 0 THEN log10(cvw) - log10(cv)
      ELSE CASE WHEN v IS NULL THEN 0 ELSE log10({BACKOFF}) END + CASE WHEN cw > 0 THEN log10(cw) - log10(greatest(rest, 1)) ELSE log10({BACKOFF}) - log10(rest + 1) END END END AS g FROM x),
s AS (SELECT r, sum(g) AS g FROM l GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(g, 0), 4) AS log_score, CASE WHEN len(ws) > 0 THEN round(g / len(ws), 6) END AS mean_log FROM d LEFT JOIN s USING (r)
"""
