"""N-gram Jaccard join by universe partition and pigeonhole, with exact verification.

A document's set are its distinct word shingles, as 64-bit hashes.  Two sets of sizes a and c whose Jaccard
similarity is at least t differ in at most (a + c)(1 - t)/(1 + t) elements.  For a band of sizes with at
most H such differences the universe is dealt into segments by hash; by pigeonhole, two similar sets agree
on some segment of any H + 1 of them.

* Size bands: a pair is looked for under the band of its larger set, so a set is indexed under its own
  band and, if sets of the next one can be similar to it, under that too.
* Segments: H differences touch at most H segments, and at most H/2 of those that two differences are needed to
  tell apart, which are segments indexed with their one-deletion neighbourhood (the subsets that lack one element).
  A segment with few elements says little and is left out, by its own content alone.  A set that keeps over H (or
  H/2) segments so keeps one in which a similar set is the same (or a neighbour), and that set has it too; a set
  that does not keep as many is indexed under all of them, so that two such sets meet as well.
* Allocation: ``allocate`` weighs index rows against agreements by chance for each band, over the number of
  segments, the least elements, and neighbourhoods or none.
* Verification: sets that share an index row are gathered into clusters by connected components.  A cluster
  is cut into blocks of bounded size; each pair of blocks is compared in full by one task.  Links leave the
  task as a spanning forest, never as all pairs.

Exact copies are grouped by a 128-bit digest of the set first; only one of a group is compared.

Defined results
---------------
* null text, or one without words: an empty set, linked with nothing, its own component.
* null doc_id: a row with its n_shingles and a null component_id, linked with nothing.
* repeated rows (or doc_ids): a row each; rows of one doc_id are in one component.
* empty table: no rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, released, scratch, stored, table
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64
M1, M2, M3, M4 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
BLOCK = 300_000  # elements of a block of a cluster
SETS = 2_000  # sets of a block of a cluster
STRIP = 256  # rows of a block's matrix that are multiplied and judged at once
HELD = 3_000_000  # index rows held at once
SENT = 100_000  # index rows of a batch that goes to the executor
SALTS = 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * M1
    h = (h ^ (h >> U(27))) * M2
    return h ^ (h >> U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    parts = (text or "").encode().translate(LOWER).split()  # bytes.split() parts at 0x20 and 0x09-0x0D
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    if len(parts) < words:
        words = len(parts)
    out = np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        out = _mix(out * M3 + h[i : len(h) - words + 1 + i])
    return np.unique(_mix(out + U(words)))


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    few: int  # elements below which a segment says little
    doubles: bool  # whether segments take one-deletion neighbourhoods


class Plan:
    """The bands and their allocation for a threshold of num/den and a table of some number of rows."""

    def __init__(self, num: int, den: int, rows: int, widen: float = 1.6) -> None:
        self.num, self.den = num, den
        self.bands: list[Band] = []
        low = 1
        while self.most(low, low * den // num) == 0:
            low += 1
        while low < 1 << 31:
            high = max(low, int(low * max(widen, den / num + 0.02)))
            self.bands.append(Band(low, high, *self.allocate(low, high, rows)))
            low = high + 1
        self.lows = np.array([b.low for b in self.bands])

    def most(self, a: int, c: int) -> int:
        """The most elements in which similar sets of these sizes can differ."""
        return (a + c) * (self.den - self.num) // (self.den + self.num)

    def apart(self, n: int, high: int) -> int:
        """The most elements in which a set of n differs from a similar one of at most ``high``."""
        return self.most(n, min(high, n * self.den // self.num))

    def allocate(self, low: int, high: int, rows: int) -> tuple[int, int, bool]:
        """Segments, least elements and neighbourhoods of a band, at the least expected cost.

        Costs are index rows a set, and the sets that agree by chance: one set in fifty shares an eighth of the
        elements.  Only allocations count that leave a set enough segments, by three deviations.
        """
        best = (math.inf, 1, 0, True)
        sizes = sorted({low, int((low * high) ** 0.5), high})
        for doubles in (False, True):
            required = {n: (self.apart(n, high) // 2 if doubles else self.apart(n, high)) + 1 for n in sizes}
            most = max(required.values())
            for segments in sorted({most + most * k // 8 + j for k in range(17) for j in (0, 1)}):
                for few in (0, 2, 3, 4, 5, 6):
                    cost = 0.0
                    for n in sizes:
                        t = n / segments
                        k = np.arange(0, int(t + 8 * math.sqrt(t) + 12))
                        p = np.exp(k * math.log(t) - t - np.array([math.lgamma(x + 1) for x in k]))
                        good = float(p[few:].sum())
                        if few and segments * good - 3 * math.sqrt(segments * good * (1 - good)) < required[n]:
                            cost = math.inf
                            break
                        index = (p * (k + 1))[few:].sum() if doubles else good
                        chance = (p * (k + 1) * 0.125 ** np.maximum(0, k - 1))[few:].sum() if doubles else (p * 0.125**k)[few:].sum()
                        cost = max(cost, segments * float(index + rows / 50 * chance))
                    best = min(best, (cost, segments, few, doubles))
        return best[1:]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """The index rows of a set."""
        n, out = len(s), []
        k = int(np.searchsorted(self.lows, n, "right")) - 1
        reach = n * self.den // self.num
        if k < 0 and reach < self.bands[0].low:
            return np.zeros(0, np.uint64)
        for b in ([k] if k >= 0 else []) + ([k + 1] if reach >= self.bands[k + 1].low else []):
            band = self.bands[b]
            apart = self.apart(n, band.high)
            seg = ((s * M4 >> U(32)) * U(band.segments) >> U(32)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            vals = _mix(s[order] + M3)
            count = np.bincount(seg, minlength=band.segments)
            ends = np.cumsum(count)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vals, dtype=np.uint64)])
            sums = run[ends] - run[ends - count]
            salt = _mix((U(b) << U(32)) + np.arange(band.segments, dtype=np.uint64))
            good = count >= band.few
            if int(good.sum()) < (apart // 2 if band.doubles else apart) + 1:
                good[:] = True  # too few say enough: all count then
            # With neighbourhoods, a segment with one element less can be another's neighbour.
            whole = good | (count == band.few - 1) if band.doubles else good
            out.append(_mix(sums[whole] ^ salt[whole]))
            if band.doubles:
                near = good[seg[order]]
                at = seg[order][near]
                out.append(_mix((sums[at] - vals[near]) ^ salt[at]))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def linked_groups(sets: list[np.ndarray], num: int, den: int, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set the first set of its component under links; compares all pairs exactly.

    With ``sides`` only pairs of different sides are compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    root = np.arange(n)
    if n < 2:
        return root
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(first) - 1
    df = np.bincount(col)
    shared = np.zeros((n, n), np.float32)
    dense = max(16, n // 64)
    rare = (df[col] > 1) & (df[col] < dense)
    c, o = col[rare], owner[rare]
    step = 1
    while len(c) > step:  # pairs of holders of a rare element: the one and the step-th after it
        same = c[step:] == c[:-step]
        if not same.any():
            break
        np.add.at(shared, (o[:-step][same], o[step:][same]), 1)
        step += 1
    many = df[col] >= dense
    cols, o = np.unique(col[many], return_inverse=True)[1], owner[many]
    wide = 2048
    for a in range(0, int(cols.max()) + 1 if len(cols) else 0, wide):
        own = (cols >= a) & (cols < a + wide)
        x = np.zeros((n, wide), np.float32)
        x[o[own], cols[own] - a] = 1
        for top in range(0, n, STRIP):
            shared[top : top + STRIP, top:] += x[top : top + STRIP] @ x[top:].T
    # Strip by strip, so that beside the matrix only a strip's pairs are held.
    for top in range(0, n, STRIP):
        part = shared[top : top + STRIP, top:]
        i, j = np.nonzero(np.triu(part, 1))
        both = part[i, j].astype(np.int64)
        i, j = i + top, j + top
        ok = den * both >= num * (size[i] + size[j] - both)
        if sides is not None:
            ok &= sides[i] != sides[j]
        root = _joined(root, i[ok], j[ok])
    return root


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first member of each one's group, after the groups of i and j are made one."""
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new[new]]
        if (new == root).all() and (root[i] == root[j]).all():
            break
        root = new
    return root


def _batches(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(row, set, digest) of the rows of a batch that have a doc_id and a set."""
    for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
        if doc_id is not None and len(s := shingles(text.as_py(), words)):
            yield i, s, hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest and first: the smallest doc_id with that digest among the rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n, digests, least = [0] * len(ids), [None] * len(ids), {}
            for i, text in enumerate(batch.column(1)):
                s = shingles(text.as_py(), words)
                n[i] = len(s)
                if len(s) and ids[i] is not None:
                    digests[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    least[digests[i]] = min(ids[i], least.get(digests[i], ids[i]))
            first = [None if d is None else least[d] for d in digests]
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(first, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "first"])

    return _small(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, first long")


def _small(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def met(rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index rows and their holders, a row of the smallest holder only.

    The other holders meet it under a row of their own pair, so that who meets whom stays the same and a
    row that all documents share is held once.
    """
    by = np.lexsort((owner, rows))
    rows, owner = rows[by], owner[by]
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1]
    del by
    start, again = np.flatnonzero(new), np.flatnonzero(~new)
    pair = np.stack([owner[again], owner[start[np.searchsorted(start, again) - 1]]])
    pair = pair[:, pair[0] != pair[1]]
    pair = pair[:, np.lexsort(pair[::-1])]
    pair = pair[:, np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(0)])[: pair.shape[1]]]
    own = _mix(_mix(pair[0].astype(np.uint64) + M1) + pair[1].astype(np.uint64))
    return np.concatenate([rows[new], own, own]), np.concatenate([owner[new], pair[0], pair[1]])


def _index(docs: DataFrame, words: int, plan: Plan) -> DataFrame:
    """(row, doc_id): index rows and holders.  Of copies in a batch one has rows, of a row's holders one has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: dict[bytes, int] = {}
            rows, owners, n = [], [], 0

            def out() -> Iterator[pa.RecordBatch]:
                each = np.concatenate(rows), np.concatenate(owners)
                rows.clear()
                owners.clear()
                row, owner = met(*each)
                for at in range(0, len(row), SENT):  # the executor holds each batch beside its heap
                    yield pa.RecordBatch.from_arrays([pa.array(row[at : at + SENT].view(np.int64)), pa.array(owner[at : at + SENT])], ["row", "doc_id"])

            for i, s, digest in _batches(batch, words):
                if digest in held:  # a copy here: it meets the first one, and its other sets meet theirs
                    r = np.zeros(0, np.uint64)
                else:
                    held[digest] = ids[i]
                    r = plan.signatures(s)
                rows.append(r)
                owners.append(np.full(len(r), ids[i], np.int64))
                n += len(r)
                if n > HELD:
                    yield from out()
                    n = 0
            if n:
                yield from out()

    return _small(docs).mapInArrow(run, "row long, doc_id long")


def _verified(docs: DataFrame, blocks: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): links as a forest, from ``blocks`` (node, cluster, low, high, side) and the texts."""

    def run(group: pa.Table) -> pa.Table:
        nodes, side = group.column("node").to_numpy(), group.column("side").to_numpy()
        sets = [shingles(t, words) for t in group.column("text").to_pylist()]
        # A block beside itself has one side only; its rows then count as all different.
        root = linked_groups(sets, num, den, side if side.max() else None)
        other = root != np.arange(len(root))
        return pa.table({"a": nodes[other], "b": nodes[root[other]]})

    texts = _small(docs).filter("doc_id is not null").withColumnRenamed("doc_id", "node")
    # Always a sort-merge join: the plan, and with it the disk it needs, is then the same at every size.
    joined = blocks.hint("merge").join(texts.hint("merge"), "node").select("cluster", "low", "high", "node", "side", "text")
    return joined.groupBy("cluster", "low", "high").applyInArrow(run, "a long, b long")


def _chains(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(a, b): sets that share an index row, each with the one before it, by a window without a buffer."""
    w = Window.partitionBy("row").orderBy("doc_id")
    chain = rows.withColumn("last", F.lag("doc_id").over(w)).filter("doc_id <> last").select("doc_id", "last").distinct()
    by_rep = lambda df, c, out: df.join(copies.withColumnRenamed("doc_id", c), c, "left").withColumn(out, F.coalesce("rep", c)).drop("rep", c)
    return by_rep(by_rep(chain, "doc_id", "a"), "last", "b")


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; sets link at a similarity of num/den."""
    spark, made = docs.sparkSession, []

    def kept(df: DataFrame, what: str) -> DataFrame:
        made.append(scratch(spark, what))
        df = stored(df, what, made[-1])
        released(spark)
        return df

    plan = Plan(num, den, docs.count())
    sets = kept(_sets(docs, words), "jaccard-sets")
    # Exact copies: the smallest doc_id of each digest stands for it.  A batch sends one row a digest, so
    # that a group of copies of any size is a few rows here.
    known = sets.filter("digest is not null")
    firsts = known.select("digest", "first").distinct()
    least = firsts.groupBy("digest").agg(F.min("first").alias("rep"))
    named = firsts.join(least, "digest")
    reps = kept(known.join(named, ["first", "digest"]).select("doc_id", "n_shingles", "rep"), "jaccard-reps")
    # A copy goes by its representative, unless its doc_id has other texts too: then it stands for them all.
    per = reps.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    copies = kept(per.filter("lo = hi and lo <> doc_id").select("doc_id", F.col("lo").alias("rep")), "jaccard-copies")
    found = components(_chains(_index(docs, words, plan), copies), "a", "b")
    # Every cluster into blocks, every pair of its blocks into one group.
    sizes = reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n")).withColumnRenamed("doc_id", "node")
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    members = kept(salted(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).join(sizes, "node")), "jaccard-members")
    total = members.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("sets"))
    cuts = F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("sets") / SETS)).cast("long")
    total = total.select("component", cuts.alias("cuts"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    cut = members.join(total, ["component", "salt"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("cuts")))
    each = cut.select("node", F.col("component").alias("cluster"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("with"))
    blocks = each.select("node", "cluster", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), (F.col("block") > F.col("with")).cast("int").alias("side"))
    links = _verified(docs, blocks, words, num, den)
    # A doc_id with several texts belongs to each one's group.
    twins = reps.join(per.filter("lo <> hi").select("doc_id"), "doc_id", "left_semi").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(links.unionByName(twins), "a", "b")
    done = reps.join(joined, reps["rep"] == joined["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    done = stored(done.unionByName(sets.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "jaccard-result")
    for path in made:
        dropped(spark, path)
    return done


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


# Brute force in SQL: all pairs of distinct sets that share a shingle, then components by repeated steps.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS s FROM w),
reps AS MATERIALIZED (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tok AS MATERIALIZED (SELECT rep, n, unnest(s) AS t FROM reps),
links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM tok a JOIN tok b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT rep, rep FROM reps UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
comp AS MATERIALIZED (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp.root, sets.doc_id)::BIGINT AS component_id
FROM sets LEFT JOIN reps ON sets.s = reps.s LEFT JOIN comp ON comp.node = reps.rep
"""
