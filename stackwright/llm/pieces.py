"""SentencePiece encoding and decoding by batched numpy Viterbi over a public piece table.

The table is a BPE model, so the best path is the one that merging would give.  A path is that one if and
only if each two neighbouring pieces, taken alone, merge to themselves; hence for each prefix exactly one
last piece fits.  Equal-length words advance together, one character a step: hashes of all substrings that
end there probe the sorted piece keys, neighbours that would merge otherwise are ruled out, and a
vectorised maximum stores the back pointer.  Ids equal those of the sentencepiece library.

Words do not influence each other, as no piece holds a character before a space mark; each distinct word
of a batch is solved once.  No shuffle; a row's result needs that row only.

Defined results
---------------
* null or empty text: no pieces, decoded to the empty text.
* characters without a piece become their UTF-8 bytes' pieces.  U+2581 counts as a space, so a text that
  holds it decodes with spaces in its place (``lossless`` is false there, and there only).
* null doc_id and repeated rows: a row each.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_pieces long, n_fallback long, ids binary, ids_crc32 long, lossless boolean"
START = -1


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _merged(parts: list[str], rank: dict[str, int]) -> list[str]:
    """The pieces that merging leaves of a short string; the last merge is what its caller looks for."""
    parts = list(parts)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 40))
        if parts[best] + parts[best + 1] not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class PieceTable:
    """The arrays that encoding needs, in the order of merging: characters first, then merges by score."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        odd = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.raw = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if odd[i] else names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        usable = [i for i in range(size) if not odd[i]]
        self.runs = {len(names[i]): i for i in usable if set(names[i]) == {SPACE}}
        if any(SPACE in names[i][1:] and len(names[i]) not in self.runs for i in usable):
            raise ValueError("a piece goes on after a space mark")
        words = [i for i in usable if len(names[i]) == 1 or names[i].strip(SPACE)]
        chars = [i for i in words if len(names[i]) == 1]
        merges = sorted((i for i in words if len(names[i]) > 1), key=lambda i: -model.get_score(i))
        rank = {names[i]: k for k, i in enumerate(merges)}
        merges = [i for i in merges if len(_merged(list(names[i]), rank)) == 1]  # the others never arise
        order, set_ = chars + merges, set(merges)
        self.ids = np.array(order, np.int32)
        self.score = np.array([float(model.get_score(i)) if i in set_ else 0.0 for i in order])
        at = {names[i]: k for k, i in enumerate(order)}
        self.known = frozenset(names[i] for i in chars)
        self.longest = max(len(names[i]) for i in order)
        keys = np.array([self._key(names[i]) for i in order], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        by = np.argsort(keys)
        self.keys, self.places = keys[by], by.astype(np.int32)
        self.some = self._sieve(self.keys)
        # The halves of each piece's own last merge, and all pairs of pieces that make a piece.
        n = len(order)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        pairs, makes = [], []
        for k, i in enumerate(order):
            name = names[i]
            if len(name) > 1:
                a, b = self._halves(name, rank)
                self.left[k], self.right[k] = at[a], at[b]
                for cut in range(1, len(name)):
                    if name[:cut] in at and name[cut:] in at:
                        pairs.append(at[name[:cut]] * n + at[name[cut:]])
                        makes.append(k)
        by = np.argsort(pairs)
        self.pairs, self.makes = np.array(pairs, np.int64)[by], np.array(makes, np.int64)[by]
        self.some_pairs = self._sieve(self.pairs.astype(np.uint64) * BASE)
        # No merge crosses two characters that stand together in no piece.  Class 0: characters without one.
        self.klass = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(sorted(self.known)):
            self.klass[ord(c)] = k + 1
        self.beside = np.zeros((len(self.known) + 1, len(self.known) + 1), bool)
        for name in at:
            for a, b in zip(name, name[1:]):
                self.beside[self.klass[ord(a)], self.klass[ord(b)]] = True

    @staticmethod
    def _halves(name: str, rank: dict[str, int]) -> tuple[str, str]:
        parts = list(name)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 40))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    @staticmethod
    def _key(name: str) -> int:
        h = 0
        for c in name:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _sieve(hashes: np.ndarray) -> np.ndarray:
        """Marks by the top 22 bits: most probes that miss end here, before the search in sorted keys."""
        out = np.zeros(1 << 22, bool)
        out[(hashes >> np.uint64(42)).astype(np.int64)] = True
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and the pieces."""
        may = np.flatnonzero(self.some[(h >> np.uint64(42)).astype(np.int64)])
        i = np.searchsorted(self.keys, h[may])
        i[i == len(self.keys)] = 0
        real = self.keys[i] == h[may]
        return may[real], self.places[i[real]].astype(np.int64)

    def _makes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces make together, or a number beyond all pieces."""
        key = a * len(self.ids) + b
        out = np.full(len(key), 1 << 40, np.int64)
        may = np.flatnonzero(self.some_pairs[((key.astype(np.uint64) * BASE) >> np.uint64(42)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.pairs, key[may]), len(self.pairs) - 1)
        real = self.pairs[i] == key[may]
        out[may[real]] = self.makes[i[real]]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b side by side stay as they are under merging.

        Their merges are undone from the latest back.  If, before the merge undone last, the two pieces at
        the border could have made one of an earlier rank, they would have.
        """
        out, open_ = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 39, np.int64)
        while len(open_):
            early = self._makes(a, b) < limit
            out[open_[early]] = False
            can_a, can_b = self.left[a] != a, self.left[b] != b
            undo_a = can_a & (~can_b | (a > b))
            undo_b = can_b & ~undo_a
            # On the left an equal rank further right comes later; on the right it comes first.
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            more = ~early & (undo_a | undo_b)
            open_, a, b, limit = open_[more], a[more], b[more], limit[more]
        return out

    def run(self, n: int) -> list[int]:
        """The pieces of n space marks: as long ones as there are, from the left."""
        most, out = max(self.runs), []
        while n:
            k = min(n, most)
            while k not in self.runs:
                k -= 1
            out.append(self.runs[k])
            n -= k
        return out


class Encoder:
    """Encodes texts; distinct words are kept up to a bound."""

    def __init__(self, pieces: PieceTable, keep: int = 250_000, batch_chars: int = 400_000) -> None:
        self.p, self.keep, self.batch_chars = pieces, keep, batch_chars
        self.memo_key = np.full(1 << 20, -1, np.int64)
        self.memo_val = np.zeros(1 << 20, bool)
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.start, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.used = 0

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.p.ids) + b
        slot = ((key.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64)
        out, miss = self.memo_val[slot], self.memo_key[slot] != key
        if miss.any():
            some, back = np.unique(key[miss], return_inverse=True)
            new = self.p.fits(some // len(self.p.ids), some % len(self.p.ids))[back]
            self.memo_key[slot[miss]], self.memo_val[slot[miss]] = key[miss], new
            # Two keys may share a slot: the one that lost must not leave its answer there.
            self.memo_val[slot[miss]] = np.where(self.memo_key[slot[miss]] == key[miss], new, self.memo_val[slot[miss]])
            lost = self.memo_key[slot[miss]] != key[miss]
            if lost.any():
                self.memo_key[slot[miss][lost]] = -1
            out = out.copy()
            out[miss] = new
        return out

    def _advance(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Back pointers and last pieces of words of one length."""
        size, count, p = len(words[0]), len(words), self.p
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, size).T.astype(np.uint64) + np.uint64(1)
        power = [np.uint64(1)]
        for _ in range(p.longest):
            power.append(np.uint64(int(power[-1]) * int(BASE) & 0xFFFFFFFFFFFFFFFF))
        prefix = np.zeros((size + 1, count), np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * BASE + codes[j]
        last, back = np.full((size + 1, count), START, np.int64), np.zeros((size + 1, count), np.int8)
        best = np.full((size + 1, count), -np.inf)
        best[0] = 0
        for j in range(1, size + 1):
            for k in range(min(p.longest, j), 0, -1):
                h = prefix[j] - prefix[j - k] * power[k]
                row, piece = p.find(h)
                if not len(row):
                    continue
                score = best[j - k, row] + p.score[piece]
                if j > k:
                    score[~self._fits(last[j - k, row], piece)] = -np.inf
                better = score > best[j, row]
                row = row[better]
                best[j, row], last[j, row], back[j, row] = score[better], piece[better], k
        if (best[size] == -np.inf).any():
            raise ValueError("a word without a path")
        return last, back

    def _learn(self, fragments: list[str]) -> None:
        """Adds new fragments: characters that can merge, or one character without a piece."""
        by: dict[int, list[str]] = {}
        for f in fragments:
            by.setdefault(len(f) if f in self.p.known or len(f) > 1 else 0, []).append(f)
        for f in by.pop(0, ()):
            ids = self.p.byte_ids[list(f.encode())]
            self._add([f], ids, np.array([len(ids)]))
        for size, words in by.items():
            step = max(1, self.batch_chars // size)
            for s in range(0, len(words), step):
                some = words[s : s + step]
                last, back = self._advance(some)
                count, rows = len(some), np.arange(len(some))
                ids, n, at = np.full((size, count), -1, np.int32), np.zeros(count, np.int64), np.full(count, size)
                while len(rows):
                    n[rows] += 1
                    ids[size - n[rows], rows] = self.p.ids[last[at[rows], rows]]
                    at[rows] -= back[at[rows], rows]
                    rows = rows[at[rows] > 0]
                flat = ids.T.ravel()
                self._add(some, flat[flat >= 0], n)

    def _add(self, fragments: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        i, k = len(self.words), len(fragments)
        while i + k > len(self.n):
            self.n, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.n, self.start))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.n[i : i + k], self.start[i : i + k] = n, self.used + np.cumsum(n) - n
        self.words.update(zip(fragments, range(i, i + k)))
        self.used += len(ids)

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """Lone space marks side by side merge last, after all letters."""
        lone = ids == self.p.runs[1]
        edge = np.diff(np.concatenate([[0], lone.astype(np.int8), [0]]))
        out, at = [], 0
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a > 1:
                out += [ids[at:a], np.array(self.p.run(b - a), np.int32)]
                at = b
        return np.concatenate([*out, ids[at:]]) if out else ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > self.keep:
            self._clear()
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        if not whole:
            return [np.zeros(0, np.int32) for _ in texts]
        klass = self.p.klass[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(whole) + 1, bool)
        cut[1:-1] = ~self.p.beside[klass[:-1], klass[1:]]
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        cut[ends] = True
        at = np.flatnonzero(cut).tolist()
        fragments = [whole[a:b] for a, b in zip(at, at[1:])]
        if new := set(fragments).difference(self.words):
            self._learn(list(new))
        which = np.fromiter(map(self.words.__getitem__, fragments), np.int64, len(fragments))
        n, start = self.n[which].astype(np.int64), self.start[which]
        after = np.cumsum(n)
        ids = self.flat[np.arange(int(after[-1])) + np.repeat(start - (after - n), n)]
        border = np.searchsorted(np.array(at), ends)  # fragments up to the end of each text
        found = np.split(ids, np.concatenate([[0], after])[border][:-1])
        return [self._runs(x) if SPACE * 2 in m else x for x, m in zip(found, marked)]


class Decoder:
    """Texts of many id arrays at once: the pieces' bytes are gathered from one flat array."""

    def __init__(self, pieces: PieceTable) -> None:
        self.n = np.array([len(x) for x in pieces.raw], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(pieces.raw), np.uint8)

    def decode(self, found: list[np.ndarray]) -> list[str]:
        """Each text: the pieces' bytes joined, less the space mark at the front."""
        if not found:
            return []
        ids = np.concatenate(found).astype(np.int64)
        n, ends = self.n[ids], np.cumsum([len(x) for x in found])
        stop = np.concatenate([[0], np.cumsum(n)])
        raw = self.flat[np.arange(int(stop[-1])) + np.repeat(self.at[ids] - stop[:-1], n)].tobytes()
        cuts = [0, *stop[ends].tolist()]
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def encode_documents(docs: DataFrame, path: str | None = None, chars: int = 2_000_000) -> DataFrame:
    """Ids (little-endian unsigned 16-bit), their count and checksum, and whether they decode to the text."""
    held = docs.sparkSession.sparkContext.broadcast(PieceTable(path or model_path()))
    if len(held.value.raw) > 1 << 16:
        raise ValueError("ids do not fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        encoder, decoder = Encoder(p), Decoder(p)
        for batch in batches:
            doc_ids, texts, i = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j]) <= chars):
                    n += len(texts[j])
                    j += 1
                found = encoder.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(i, j - i),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([int(p.is_byte[x].sum()) for x in found], pa.int64()),
                        pa.array([x.astype("<u2").tobytes() for x in found], pa.binary()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                        pa.array([x == t for x, t in zip(decoder.decode(found), texts[i:j])], pa.bool_()),
                    ],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )
                i = j

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from the ids of ``encode_documents``."""
    held = encoded.sparkSession.sparkContext.broadcast(PieceTable(path or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in batches:
            texts = decoder.decode([np.frombuffer(x or b"", "<u2") for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
