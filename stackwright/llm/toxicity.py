"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A word is the attention-pooled states of a bidirectional GRU over its characters, beside an embedding of
the word if it is a frequent one.  A second bidirectional GRU with attention runs over windows of 32 words, one
from every eighth word; all windows of a text are scored, and the highest decides.  A one-dimensional logistic fit
on the labelled documents' highest window scores turns that into a probability at the labels' own rates.

Training: labels count only from rows whose crc32(doc_id as text) mod 4 is not 2, and from all of these: the marks that
tell the classes apart are counted over all labelled documents (those of one class that share their least shingle are
copies and count once), the network steps over windows of all of them, and the final curve is fitted on all their
scores.  Documents are dealt into shards of about ``SHARD``; a phase goes over all windows of a shard, and after each
of its ``ROUNDS`` the shards' weights are averaged.  Of a clean document the windows are one at random and, from the
second phase on, the highest scoring one of those that lie side by side.  Scoring is one narrow pass over all texts;
characters of a distinct word are run once a batch.

Defined results
---------------
* null or empty text: one window without words.  Null doc_id: scored, held_out is false.
* repeated rows: a row each.  Empty table: no rows.  Without labels of both classes every score is the rate
  of toxic labels, or 0 without labels.
* other columns are ignored when scoring; ``reject`` keeps them all as they are.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, released, scratch, shuffles_freed, stored, table

SHARD = 16_000  # documents whose windows one task steps over
PHASES, ROUNDS, STEPS, BATCH = 3, 4, 160, 64
TELLING, TIMES = 3.5, 2.0  # deviations, and times the clean rate, by which a telling mark's toxic rate is higher
FREQUENT = 1000
FEW = 4_000_000  # scores of a task that a step of the curve reads
BITS = 1 << 25  # of the filter that spares shuffling texts without a label
WINDOWS = "h long, toxic int, sure double, words string"
WINDOW, STEP = 32, 8
H = 8  # states of a direction
LONGEST = 20  # characters of a word; longer ones are cut into several
THRESHOLD = 0.3
WORDS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}|\d{{1,{LONGEST}}}")
CHARS = 512
F32 = np.float32


def words_of(text: str | None) -> list[str]:
    """Runs of letters or of digits, in lower case, cut at ``LONGEST`` characters."""
    return WORDS.findall((text or "").lower())


def marks(word: str) -> tuple[str, str, str]:
    """A word and its beginnings, which forms of one stem share."""
    return word, word[:4] + "*", word[:5] + "*"


def sketch(words: list[str]) -> int:
    """The least hash of three words in a row: copies share it, and near copies mostly."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) > 2:
        h = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return int((h ^ (h >> np.uint64(32))).min(initial=2**64 - 1).view(np.int64))


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by place: np.add.at, by sorting."""
    out = np.zeros((n, rows.shape[1]), F32)
    if len(at):
        by = np.argsort(at, kind="stable")
        at = at[by]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.add.reduceat(rows[by], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Ragged:
    """Rows of different sizes, longest first, laid out step by step: a step holds the rows that are left.

    ``row`` and ``step`` say what stands at a place; ``flip`` says where it stands if its row is read from the end.
    """

    def __init__(self, sizes: np.ndarray) -> None:
        self.n, live = len(sizes), np.searchsorted(-sizes, -np.arange(sizes[0]))
        first = np.cumsum(live) - live
        self.steps = [(slice(a, a + k), k) for a, k in zip(first.tolist(), live.tolist())]
        self.step = np.repeat(np.arange(len(live)), live)
        self.row = np.arange(len(self.step)) - first[self.step]
        self.flip = first[sizes[self.row] - 1 - self.step] + self.row

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums by row."""
        return np.bincount(self.row, x, self.n).astype(F32)

    def shares(self, s: np.ndarray) -> np.ndarray:
        """The softmax within each row."""
        top = np.full(self.n, -np.inf, F32)
        for at, k in self.steps:
            np.maximum(top[:k], s[at], out=top[:k])
        a = np.exp(s - top[self.row])
        return a / self.sums(a)[self.row]


class Gru:
    """One direction.  Inputs are rows of a table of projected inputs, 3H for reset, update and candidate; states are
    columns, (H, places), so that each gate is one run of memory."""

    @staticmethod
    def forward(table: np.ndarray, codes: np.ndarray, shape: Ragged, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        states, held, w, last = np.empty((H, len(codes)), F32), [], np.ascontiguousarray(u.T), np.zeros((H, shape.n), F32)
        for at, k in shape.steps:
            x, h = table[codes[at]].T, last[:, :k]
            hu = w @ h
            rz = x[: 2 * H] + hu[: 2 * H]
            rz *= F32(0.5)
            np.tanh(rz, out=rz)
            rz *= F32(0.5)
            rz += F32(0.5)
            r, z = rz[:H], rz[H:]
            c = r * hu[2 * H :]
            c += x[2 * H :]
            np.tanh(c, out=c)
            new = states[:, at]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if keep:
                held.append((h, r, z, c, hu[2 * H :]))
            last = new
        return states, held

    @staticmethod
    def backward(grad: np.ndarray, held: list, shape: Ragged, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, du, dh = np.empty((3 * H, grad.shape[1]), F32), np.zeros_like(u), np.zeros((H, 0), F32)
        for (at, _), (h, r, z, c, hc) in zip(reversed(shape.steps), reversed(held)):
            d = grad[:, at].copy()
            d[:, : dh.shape[1]] += dh
            left = d * (1 - z)
            dc = left * (1 - c * c)
            dr = dc * hc * r * (1 - r)
            dhu = np.concatenate([dr, left * (h - c) * z, dc])
            dx[:, at] = dhu
            dhu[2 * H :] *= r
            du += h @ dhu.T
            dh = d * z + u @ dhu
        return dx, du


class Encoder:
    """A bidirectional GRU with attention over ragged rows of projected inputs."""

    @staticmethod
    def states(p: dict, name: str, xf: np.ndarray, xb: np.ndarray, codes: np.ndarray, shape: Ragged, keep: bool = False):
        """Both directions' states, the second from each row's end, and the attention by place."""
        f, hf = Gru.forward(xf, codes, shape, p[name + "uf"], keep)
        b, hb = Gru.forward(xb, codes[shape.flip], shape, p[name + "ub"], keep)
        v = p[name + "v"]
        return f, b, shape.shares(v[:H] @ f + (v[H:] @ b)[shape.flip]), hf, hb

    @staticmethod
    def forward(p: dict, name: str, xf: np.ndarray, xb: np.ndarray, codes: np.ndarray, shape: Ragged, keep: bool = False):
        """(2H, rows): the attended states."""
        f, b, a, hf, hb = Encoder.states(p, name, xf, xb, codes, shape, keep)
        out, back = np.zeros((2 * H, shape.n), F32), a[shape.flip]
        for at, k in shape.steps:
            out[:H, :k] += a[at] * f[:, at]
            out[H:, :k] += back[at] * b[:, at]
        return out, (f, b, a, hf, hb, shape)

    @staticmethod
    def backward(p: dict, g: dict, name: str, grad: np.ndarray, held: tuple) -> np.ndarray:
        """(places, 6H): gradients of the inputs of both directions; those of the weights go into ``g``."""
        f, b, a, hf, hb, shape = held
        v, flip, wide = p[name + "v"], shape.flip, grad[:, shape.row]
        da = (wide[:H] * f).sum(0) + (wide[H:] * b).sum(0)[flip]
        ds = a * (da - shape.sums(a * da)[shape.row])
        g[name + "v"] = np.concatenate([f @ ds, b @ ds[flip]])
        dxf, g[name + "uf"] = Gru.backward(a * wide[:H] + ds * v[:H, None], hf, shape, p[name + "uf"])
        dxb, g[name + "ub"] = Gru.backward(a[flip] * wide[H:] + ds[flip] * v[H:, None], hb, shape, p[name + "ub"])
        return np.concatenate([dxf.T, dxb.T[flip]], 1)


def _longest_first(sizes: np.ndarray) -> tuple[np.ndarray, Ragged, np.ndarray]:
    """The order of rows by size, their layout, and the place of each of its places in the rows as they stand."""
    by = np.argsort(-sizes, kind="stable")
    shape = Ragged(sizes[by])
    return by, shape, (np.cumsum(sizes) - sizes)[by][shape.row] + shape.step


def _characters(words: list[str]) -> tuple[np.ndarray, Ragged, np.ndarray]:
    """The order of words by length, their layout, and the character numbers in it."""
    by, shape, at = _longest_first(np.fromiter(map(len, words), np.int64, len(words)))
    return by, shape, (np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % CHARS).astype(np.int64)[at]


class Network:
    """The weights, and what a fit adds: the frequent words and the final logistic curve."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d = lambda *s, k: (rng.standard_normal(s) * k).astype(F32)
        self.p = {"cxf": d(CHARS, 3 * H, k=0.5), "cxb": d(CHARS, 3 * H, k=0.5)}
        for n in "cw":
            self.p |= {n + "uf": d(H, 3 * H, k=0.35), n + "ub": d(H, 3 * H, k=0.35), n + "v": d(2 * H, k=0.3)}
        self.p |= {"wxf": d(2 * H, 3 * H, k=0.35), "wxb": d(2 * H, 3 * H, k=0.35), "wb": np.zeros(6 * H, F32)}
        self.p |= {"out": d(2 * H, k=0.3), "bias": np.zeros(1, F32)}
        self.vocabulary: dict[str, int] = {}
        self.p["embed"] = np.zeros((1, 6 * H), F32)
        self.p |= {"top": d(2 * H, k=0.3), "tip": np.zeros(1, F32)}  # of the first steps alone
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.t = 0
        self.slope, self.shift, self.rate = 1.0, 0.0, 0.0
        self.fitted = False

    def word_inputs(self, words: list[str], keep: bool = False):
        """(n, 6H): projected inputs of both directions for distinct words, by their characters and themselves."""
        by, shape, codes = _characters(words)
        p = self.p
        some, held = Encoder.forward(p, "c", p["cxf"], p["cxb"], codes, shape, keep)
        pooled = np.empty((len(words), 2 * H), F32)
        pooled[by] = some.T
        known = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        x = np.concatenate([pooled @ p["wxf"], pooled @ p["wxb"]], 1) + p["embed"][known] + p["wb"]
        return x, (by, codes, pooled, known, held)

    def logits(self, x: np.ndarray, codes: np.ndarray, shape: Ragged) -> np.ndarray:
        """Of windows of rows of x."""
        out = self.p["out"]
        f, b, a, *_ = Encoder.states(self.p, "w", x[:, : 3 * H], x[:, 3 * H :], codes, shape)
        return shape.sums(a * (out[:H] @ f + (out[H:] @ b)[shape.flip])) + self.p["bias"][0]

    # --- training ---

    def step(self, windows: list[list[str]], y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Gradients of the weighted log loss."""
        distinct = {w: i for i, w in enumerate(sorted(set().union(*windows)))}
        order, shape, at = _longest_first(np.fromiter(map(len, windows), np.int64, len(windows)))
        codes = np.fromiter((distinct[w] for ws in windows for w in ws), np.int64)[at]
        y, weight = y[order], weight[order]
        x, (by, chars, char_pool, known, char_held) = self.word_inputs(list(distinct), True)
        p, g = self.p, {}
        pooled, held = Encoder.forward(p, "w", x[:, : 3 * H], x[:, 3 * H :], codes, shape, True)
        q = _sigmoid(p["out"] @ pooled + p["bias"][0])
        d = ((q - y) * weight / weight.sum()).astype(F32)
        g["out"], g["bias"] = pooled @ d, np.array([d.sum()], F32)
        dx = _summed(codes, Encoder.backward(p, g, "w", p["out"][:, None] * d, held), len(x))
        g["wb"] = dx.sum(0)
        g["embed"] = _summed(known, dx, len(p["embed"]))
        g["embed"][0] = 0
        g["wxf"], g["wxb"] = char_pool.T @ dx[:, : 3 * H], char_pool.T @ dx[:, 3 * H :]
        dchar = dx[:, : 3 * H] @ p["wxf"].T + dx[:, 3 * H :] @ p["wxb"].T
        dc = _summed(chars, Encoder.backward(p, g, "c", np.ascontiguousarray(dchar[by].T), char_held), CHARS)
        g["cxf"], g["cxb"] = dc[:, : 3 * H], dc[:, 3 * H :]
        loss = float(-(weight * np.where(y > 0, np.log(q + 1e-7), np.log(1 - q + 1e-7))).sum() / weight.sum())
        return g, loss

    def move(self, g: dict, rate: float, decay: float, second: float) -> None:
        """One step of Adam along the gradients of some of the weights."""
        self.t += 1
        for name, x in g.items():
            m, v = self.moments.setdefault(name, (np.zeros_like(x), np.zeros_like(x)))
            m += 0.1 * (x - m)
            v += second * (x * x - v)
            self.p[name] = self.p[name] - (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - (1 - second) ** self.t)) + 1e-6) + decay * rate * self.p[name]).astype(F32)

    def warm(self, told: list[str], others: list[str], rng: np.random.Generator, span: range, steps: int = 400, half: int = 96) -> None:
        """First steps of the character network alone: telling words against words of clean documents."""
        p = self.p
        for t in span:
            words = [told[i] for i in rng.integers(len(told), size=half)] + [others[i] for i in rng.integers(len(others), size=half)]
            y = np.repeat([F32(1), F32(0)], half)
            by, shape, codes = _characters(words)
            pooled, held = Encoder.forward(p, "c", p["cxf"], p["cxb"], codes, shape, True)
            d = (_sigmoid(p["top"] @ pooled + p["tip"][0]) - y[by]) / len(y)
            g = {"top": pooled @ d}
            dc = _summed(codes, Encoder.backward(p, g, "c", p["top"][:, None] * d, held), CHARS)
            g["cxf"], g["cxb"] = dc[:, : 3 * H], dc[:, 3 * H :]
            p["tip"] = p["tip"] - F32(0.05) * d.sum()
            self.move(g, 0.02 * (1 - 0.8 * t / steps), 0, 0.01)

    def fit(self, windows: list[list[str]], y: np.ndarray, weight: np.ndarray, often: int, phase: int, span: range, rng: np.random.Generator) -> None:
        """Steps ``span`` of the ``STEPS`` of a phase, which goes over all windows, the toxic ones ``often`` times each."""
        at = np.concatenate([np.flatnonzero(y == 0), np.repeat(np.flatnonzero(y), often)])
        weight = weight / np.where(y > 0, often, 1)
        size = max(BATCH, -(-len(at) // STEPS))
        order = np.concatenate([rng.permutation(at) for _ in range(-(-STEPS * size // len(at)))])
        for k in span:
            some = order[k * size : (k + 1) * size]
            g, _ = self.step([windows[i] for i in some], y[some], weight[some].astype(F32))
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            g = {name: x * F32(min(1.0, 1.0 / max(norm, 1e-9))) for name, x in g.items()}
            self.move(g, 0.02 * (1 - 0.9 * (phase * STEPS + k) / (PHASES * STEPS)), 1e-3, 0.01)

    def state(self) -> np.ndarray:
        """Weights and moments in one row, by name."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)] + [x.ravel() for k in sorted(self.moments) for x in self.moments[k]])

    def take(self, state: np.ndarray, names: list[str], t: int) -> None:
        """Sets what ``state`` gave, for moments of ``names``."""
        self.t, i = t, 0

        def next_like(x: np.ndarray) -> np.ndarray:
            nonlocal i
            i += x.size
            return state[i - x.size : i].reshape(x.shape).astype(F32)

        self.p = {k: next_like(self.p[k]) for k in sorted(self.p)}
        self.moments = {k: (next_like(self.p[k]), next_like(self.p[k])) for k in names}

    def chance(self, raw: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(raw), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw.astype(np.float64) + self.shift, -30, 30)))


class Scorer:
    """Scores texts; the inputs of distinct words are kept up to a bound."""

    def __init__(self, net: Network, keep: int = 300_000, batch: int = 1000) -> None:
        self.net, self.keep, self.batch = net, keep, batch
        self.even: dict[int, Ragged] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.x, self.used = np.zeros((4096, 6 * H), F32), 0

    def _learn(self, words: list[str]) -> None:
        words.sort(key=len)  # a batch of words of much the same length has long steps
        for s in range(0, len(words), 4096):
            some = words[s : s + 4096]
            x, _ = self.net.word_inputs(some)
            while self.used + len(some) > len(self.x):
                self.x = np.concatenate([self.x, np.zeros_like(self.x)])
            self.x[self.used : self.used + len(some)] = x
            self.ids.update(zip(some, range(self.used, self.used + len(some))))
            self.used += len(some)

    def raw(self, docs: list[list[str]]) -> np.ndarray:
        """The highest window logit of each document."""
        return self.highest(docs)[0]

    def highest(self, docs: list[list[str]], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """The highest window logit of each document and where that window begins."""
        if self.used > self.keep:
            self._clear()
        if not docs:
            return np.zeros(0, F32), np.zeros(0, np.int64)
        new = set().union(*docs).difference(self.ids)
        if new:
            self._learn(list(new))
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        best = np.where(sizes > 0, F32(-np.inf), self.net.p["bias"][0])  # no words: no states
        # Full windows: at every ``step`` words and at the end.  Shorter documents have one window each.
        n = np.where(sizes >= WINDOW, -(-(sizes - WINDOW) // step) + 1, 0)
        owner = np.repeat(np.arange(len(docs)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = first[owner] + np.minimum(k * step, sizes[owner] - WINDOW)
        span, logits = np.arange(WINDOW), np.zeros(len(owner), F32)
        for s in range(0, len(owner), self.batch):
            places = start[s : s + self.batch]
            if len(places) not in self.even:
                if len(self.even) > 1:
                    self.even.popitem()
                self.even[len(places)] = Ragged(np.full(len(places), WINDOW))
            logits[s : s + self.batch] = self.net.logits(self.x, flat[places + span[:, None]].ravel(), self.even[len(places)])
        np.maximum.at(best, owner, logits)
        place = np.zeros(len(docs), np.int64)
        top = logits == best[owner]
        place[owner[top]] = (start - first[owner])[top]
        short = np.flatnonzero((n == 0) & (sizes > 0))
        short = short[np.argsort(-sizes[short], kind="stable")]
        for s in range(0, len(short), self.batch):
            some = short[s : s + self.batch]
            shape = Ragged(sizes[some])
            best[some] = self.net.logits(self.x, flat[first[some][shape.row] + shape.step], shape)
        return best, place

    def scores(self, texts: list[str | None], chars: int = 2_000_000) -> np.ndarray:
        out, i = [], 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + len(texts[j] or "") <= chars):
                n += len(texts[j] or "")
                j += 1
            out.append(self.net.chance(self.raw([words_of(t) for t in texts[i:j]]) if self.net.fitted else np.zeros(j - i)))
            i = j
        return np.concatenate(out) if out else np.zeros(0)


def _likely(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose doc_id is in ``known``, and some others: what need not be shuffled to find the labelled."""
    at = F.expr(f"pmod(xxhash64(doc_id), {BITS}) + 1")
    found = known.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for r in found:
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy() - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "text"]).filter(pa.array(held.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0))

    return texts.filter("doc_id is not null").select("doc_id", "text", at.alias("at")).mapInArrow(run, "doc_id long, text string")


def _some(batch: pa.RecordBatch, words: int = 300_000) -> Iterator[tuple[list, list[list[str]]]]:
    """(h, toxic) and words of a batch's rows, a bounded number of words at once."""
    keys, docs, n = [], [], 0
    for h, toxic, text in zip(batch.column("h").to_pylist(), batch.column("toxic").to_pylist(), batch.column("words")):
        keys.append((h, toxic))
        docs.append(text.as_py().split())
        n += len(docs[-1])
        if n > words:
            yield keys, docs
            keys, docs, n = [], [], 0
    if keys:
        yield keys, docs


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = [words_of(t.as_py()) for t in batch.column(2)]
        cols = [batch.column(0), batch.column(1), pa.array([sketch(d) for d in docs], pa.int64()), pa.array([" ".join(d) for d in docs], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["h", "toxic", "sketch", "words"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class with a mark."""
    tally: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), *(pa.array([v[k] for v in tally.values()], pa.int64()) for k in (0, 1))], ["mark", "clean", "toxic"])

    for batch in batches:
        for keys, docs in _some(batch):
            for (_, toxic), words in zip(keys, docs):
                for m in {m for w in set(words) for m in marks(w)}:
                    tally.setdefault(m, [0, 0])[toxic] += 1
            if len(tally) > 500_000:
                yield out()
                tally.clear()
    yield out()


def _windows(rows: list[tuple[int, int, float, list[str]]]) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array([" ".join(r[3]) for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["h", "toxic", "sure", "words"])


def _rounds(net: Network, windows: DataFrame, shards: int, rounds: int, learn, steps: int) -> None:
    """``learn(net, rows, shard, span)`` in a task for each shard, its weights averaged after each round."""
    spark = windows.sparkSession
    for k in range(rounds):
        span = range(steps * k // rounds, steps * (k + 1) // rounds)
        held = spark.sparkContext.broadcast(pickle.dumps(net))

        def run(key: tuple, group: pa.Table) -> pa.Table:
            mine = pickle.loads(held.value)  # noqa: B023
            known: dict[str, str] = {}
            rows = sorted(zip(group.column("h").to_pylist(), group.column("toxic").to_pylist(), group.column("sure").to_pylist(), group.column("words").to_pylist()))
            rows = [(h, y, sure, [known.setdefault(w, w) for w in words.split()]) for h, y, sure, words in rows]
            n = len(rows) if learn(mine, rows, key[0].as_py(), span) else 0  # noqa: B023
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "t": pa.array([mine.t], pa.int64()), "names": pa.array([sorted(mine.moments)], pa.list_(pa.string())), "state": pa.array([mine.state().astype(np.float64).tobytes()], pa.binary())})

        def mean(key: tuple, group: pa.Table) -> pa.Table:
            rows = sorted((r for r in group.to_pylist()), key=lambda r: r["shard"])
            full = [r for r in rows if r["n"]] or rows[:1]
            n = sum(r["n"] for r in full)
            state = sum(np.frombuffer(r["state"]) * (r["n"] / n if n else 1.0) for r in full)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "t": pa.array([full[0]["t"]], pa.int64()), "names": pa.array([full[0]["names"]], pa.list_(pa.string())), "state": pa.array([state.tobytes()], pa.binary())})

        what = "shard long, n long, t long, names array<string>, state binary"
        made = windows.groupBy(F.expr(f"pmod(h, {shards})").alias("shard")).applyInArrow(run, what)
        n = shards
        while n > 1:  # 32 shards' weights to a task, and so on: the driver gets one row
            n = -(-n // 32)
            made = made.withColumn("part", F.expr("shard div 32")).groupBy("part").applyInArrow(mean, what)
        row = made.first()
        net.take(np.frombuffer(bytes(row.state)), list(row.names), row.t)
        held.unpersist()
        released(spark)


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> Network:
    """A network fitted on all labelled rows of ``docs`` that are not held out."""
    spark, made = docs.sparkSession, []

    def kept(df: DataFrame, what: str) -> DataFrame:
        made.append(scratch(spark, what))
        df = stored(df, what, made[-1])
        released(spark)
        return df

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    net = Network()
    net.rate = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return net
    with shuffles_freed(spark):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # One row a doc_id, of several texts one by a hash.
        each = _likely(texts, known).join(known.hint("merge"), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max_by("text", F.xxhash64("text")).alias("text"))
        rows = kept(each.select(F.xxhash64("doc_id").alias("h"), "toxic", "text").mapInArrow(_words, "h long, toxic int, sketch long, words string"), "toxicity-rows")
        _fit(net, rows, kept, shard)
    for path in made:
        dropped(spark, path)
    return net


def _fit(net: Network, rows: DataFrame, kept, shard: int) -> None:
    spark = rows.sparkSession
    found = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return
    shards = -(-(found[0] + found[1]) // shard)
    # Marks by class, over one of the copies each.
    reps = rows.groupBy("toxic", "sketch").agg(F.min("h").alias("h"))
    n = {r.toxic: r.n for r in reps.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    one = rows.drop("sketch").join(reps.select("toxic", "h").hint("merge"), ["toxic", "h"], "left_semi").select("h", "toxic", "words")
    tally = kept(one.mapInArrow(_marked, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")), "toxicity-marks")
    whole = n[0] + n[1]
    rate = F.expr(f"(a + b) / {whole}D")
    gap = (F.expr(f"b / {n[1]}D - a / {n[0]}D") / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / n[1] + 1 / n[0]))).alias("gap")
    tells = (F.col("b") >= 3) & (F.col("gap") > TELLING) & F.expr(f"b / {n[1]}D >= {TIMES} * a / {n[0]}D")
    tally = tally.select("mark", "a", "b", gap).withColumn("gap", F.when(tells, F.col("gap")).otherwise(0.0))
    odds = {r.mark: r.gap for r in tally.filter("gap > 0").select("mark", "gap").collect()}
    frequent = tally.filter((F.substring("mark", -1, 1) != "*") & (F.col("a") + F.col("b") >= max(3, whole // 100))).orderBy(F.desc("gap"), F.desc(F.col("a") + F.col("b")), "mark").limit(FREQUENT).collect()
    net.vocabulary = {r.mark: i + 1 for i, r in enumerate(frequent)}
    net.p["embed"] = np.zeros((len(frequent) + 1, 6 * H), F32)
    held = spark.sparkContext.broadcast(odds)

    # A toxic document's window holds its most telling word; one without any may owe its label to chance
    # and counts little.  Clean documents give a window at random, then, twice, the one that scores highest.
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, float] = {}
        for batch in batches:
            for keys, docs in _some(batch):
                out = []
                for (h, toxic), words in zip(keys, docs):
                    if not words:
                        continue
                    at, sure = (h >> 8) % len(words), 1.0
                    if toxic:
                        for w in set(words).difference(best):
                            best[w] = max(held.value.get(f, 0.0) for f in marks(w))
                        tell = [best[w] for w in words]
                        at = int(np.argmax(tell))
                        sure = 1.0 if tell[at] else 0.02
                    start = max(0, min(at - h % WINDOW, len(words) - WINDOW))
                    out.append((h, toxic, sure, words[start : start + WINDOW]))
                if len(best) > 500_000:
                    best.clear()
                yield _windows(out)

    start = kept(rows.select("h", "toxic", "words").mapInArrow(first, WINDOWS), "toxicity-windows")
    sums = {r.toxic: (r.n, r.sure) for r in start.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("sure").alias("sure")).collect()}
    if not sums:
        return

    def warmed(mine: Network, some: list, key: int, span: range) -> bool:
        told = sorted({w for _, y, _, words in some if y for w in words if any(f in held.value for f in marks(w))})
        others = [w for _, y, _, words in some if not y for w in words]
        if told and others:
            mine.warm(told, others, np.random.default_rng([11, key, span.start]), span)
        return bool(told and others)

    if odds and 0 in sums:
        _rounds(net, start, shards, 2, warmed, 400)
        # The direction found is where the word network begins.
        rng = np.random.default_rng(11)
        for name in ("wxf", "wxb"):
            net.p[name] = net.p[name] + np.outer(net.p["top"], rng.standard_normal(3 * H) * 0.3).astype(F32)
    net.t, net.moments = 0, {}
    net.fitted = True
    for phase in range(PHASES):
        windows, clean = start, sums.get(0, (0, 0))[0]
        if phase and clean:
            windows, clean = start.unionByName(_hardest(rows, net, kept)), 2 * clean
        scale = (0.5 / max(1, clean), 0.5 / max(1e-3, sums.get(1, (0, 0.0))[1]))
        often = max(1, round((scale[1] / scale[0]) ** 0.5)) if clean else 1

        def learn(mine: Network, some: list, key: int, span: range) -> bool:
            y = np.array([r[1] for r in some], F32)
            weight = np.array([r[2] * scale[r[1]] for r in some])  # noqa: B023
            mine.fit([r[3] for r in some], y, weight / weight.max(), often, phase, span, np.random.default_rng([11, phase, key]))  # noqa: B023
            return True

        _rounds(net, windows, shards, ROUNDS, learn, STEPS)
    net.t, net.moments = 0, {}
    _curve(net, rows, found, kept)


def _hardest(rows: DataFrame, net: Network, kept) -> DataFrame:
    """Of each clean document with words the window that scores highest, of windows side by side."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for keys, docs in _some(batch):
                yield _windows([(h, 0, 1.0, d[at : at + WINDOW]) for (h, _), d, at in zip(keys, docs, scorer.highest(docs, WINDOW)[1].tolist()) if d])

    return kept(rows.filter("toxic = 0").select("h", "toxic", "words").mapInArrow(run, WINDOWS), "toxicity-hardest")


def _curve(net: Network, rows: DataFrame, found: dict[int, int], kept) -> None:
    """The logistic curve from all labelled documents' highest scores to their labels, at the labels' rate."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for keys, docs in _some(batch):
                yield pa.RecordBatch.from_arrays([pa.array([t for _, t in keys], pa.int32()), pa.array(scorer.raw(docs).astype(np.float64))], ["toxic", "raw"])

    share = net.rate
    raws = kept(rows.select("h", "toxic", "words").mapInArrow(run, "toxic int, raw double"), "toxicity-scores")
    # Every step reads all scores: they lie in few files, so that a step is few tasks, and its plan never changes.
    raws = kept(raws.coalesce(sum(found.values()) // FEW + 1), "toxicity-scores")
    weigh = (1 - share) / found[0], share / found[1]
    center = raws.withColumn("w", F.when(F.col("toxic") > 0, weigh[1]).otherwise(weigh[0])).agg(F.sum(F.col("w") * F.col("raw")) / F.sum("w")).first()[0]
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(50):  # Newton steps of a weighted logistic regression, lightly held to a slope of 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = np.zeros(5)
            for batch in batches:
                toxic, z = batch.column(0).to_numpy(), batch.column(1).to_numpy() - center
                q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))  # noqa: B023
                w = np.where(toxic > 0, weigh[1], weigh[0])
                e, k = w * (q - toxic), w * q * (1 - q)
                r += [(k * z * z).sum(), (k * z).sum(), k.sum(), (e * z).sum(), e.sum()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in r], [f"r{i}" for i in range(5)])

        r = np.sum([list(x) for x in raws.mapInArrow(sums, ", ".join(f"r{i} double" for i in range(5))).collect()], 0)
        step = np.linalg.solve([[r[0] + 1e-3, r[1]], [r[1], r[2] + 1e-6]], [r[3] + 1e-3 * (a - 1), r[4]])
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-7:
            break
    net.slope, net.shift = max(a, 1e-3), b - max(a, 1e-3) * center


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            s = scorer.scores(batch.column(2).to_pylist())
            cols = [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(s >= THRESHOLD, pa.int32())] if len(s) else [batch.column(0), batch.column(1), pa.array([], pa.float64()), pa.array([], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", out.alias("held_out"), "text")
    return small.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(k).to_pylist()) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
