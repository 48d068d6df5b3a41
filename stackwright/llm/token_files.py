"""Token ids in files coded by a static range asymmetric numeral system (rANS).

Texts are encoded with a public byte-level BPE tokenizer; an end id follows each document.  One frequency
table, counted over all documents, is shared by all files.  Each document is a block of its own with one
coder state for every 512 ids; the states take turns (id i belongs to state i mod k), so that numpy decodes
all states of many blocks side by side.  A file holds the blocks of one range of doc_ids in ascending order
and a footer with checkpoints: for each block its doc_id, its first byte, its number of ids and the CRC32
of its ids.  Any block can be decoded on its own.

Steps: ids are written once to the shared folder (with counts for the table); blocks are coded from there,
dealt by ranges of doc_id and appended to one file a range; a small manifest gives each range the number of
ids before it.  Only coded blocks are shuffled.  A file has a random name and is named only by the rows of
the attempt that wrote it.

Defined results
---------------
* null text: as the empty text; both are the end id alone.
* null doc_ids come first, in the order of their content; so do rows that share a doc_id.
* repeated rows: a row each.  Empty table: no files, no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import opened, scratch, table

END = 0
LANE = 512  # ids of a coder state
SCALE = 20  # frequencies add up to 2**SCALE
LOW = 1 << 31
FILE_IDS = 1 << 26  # ids of a file, about
MAGIC = b"SWRANS01"
SPECIAL = "<|endoftext|>"
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("at", "<u8"), ("n", "<u4"), ("crc", "<u4")])
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
U64 = np.uint64


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- encoding --------------------------------------------------------------------------------------


class Tokens:
    """Ids of texts.  The library encodes each distinct word once; words never merge.

    Words of a batch are found, hashed and looked up in arrays of characters.  A word found by its hash is
    compared with the known one character by character, so a collision costs time and never a wrong id.
    """

    def __init__(self, path: str, keep: int = 1_500_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        split = json.loads(self.library.to_str())["pre_tokenizer"]
        if split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
            raise ValueError("another way of splitting words")
        self.keep = keep
        # Sorts of characters, as the pattern knows them: 0 others, 1 letters, 2 numbers, 3 white space.
        every = "".join(map(chr, range(0x110000)))
        self.sort = np.zeros(0x110000, np.uint8)
        for k, sort in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(sort, every):
                self.sort[m.start() : m.end()] = k
        # A word's hash: its characters' random numbers times powers of an odd number, in 64 bits.
        draw = np.random.default_rng(11)
        self.noise = draw.integers(0, 1 << 64, 0x110000, np.uint64)
        self.odd = draw.integers(0, 1 << 64, 1, np.uint64) | U64(1)
        self.powers = np.ones(1, np.uint64)
        self._clear()

    def _cuts(self, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pattern parts joined texts; ``ends``: of each text.

        Words are runs of one sort.  Of white space before a word, a last space belongs to the word, another
        last character stands alone, and the rest is one word; at a text's end the whole run is.  An
        apostrophe that begins a word takes the letters of a contraction with it.
        """
        sort, size = self.sort[code], len(code)
        cut = np.ones(size + 4, bool)
        cut[1:size] = sort[1:] != sort[:-1]
        stop = np.zeros(size + 4, bool)
        stop[ends] = True
        stop[size:] = True
        cut |= stop
        word = np.flatnonzero(cut[:size] & (sort != 3))  # first characters of words
        inner = word[word > 0]
        inner = inner[(sort[inner - 1] == 3) & ~stop[inner]]
        cut[inner - 1] = True  # the last white space parts from those before it
        cut[inner[code[inner - 1] == 32]] = False  # and joins the word if it is a space
        mark = np.flatnonzero(code == 39)
        mark = mark[cut[mark] & ~stop[mark + 1]]
        if len(mark):
            padded = np.append(code, np.zeros(2, np.uint32))
            one, two = padded[mark + 1], np.where(stop[mark + 2], 0, padded[mark + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            cut[mark[short | long] + 1] = False
            cut[mark[short] + 2] = True
            cut[mark[long] + 3] = True
        return cut[: size + 1]

    def _clear(self) -> None:
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted, and the word of each
        self.first = np.zeros((1 << 18) + 1, np.int32)  # where hashes begin by their top 18 bits
        self.chars, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.start, self.n = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _hashes(self, code: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of words of ``code``; equal words have equal hashes wherever they stand."""
        most = int(size.max())
        if len(self.powers) <= most:
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * most, self.odd[0], np.uint64), dtype=np.uint64)])
        place = np.arange(len(code)) - np.repeat(at, size)
        run = self.noise[code] * self.powers[place]
        return np.add.reduceat(run, at) + size.astype(np.uint64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The known word of each hash, -1 without one."""
        top = (h >> U64(46)).astype(np.int64)
        place, end = self.first[top], self.first[top + 1]
        found = np.full(len(h), -1, np.int32)
        live = np.flatnonzero(place < end)
        while len(live):  # a few steps: hashes are even
            here = self.hashes[place[live]]
            hit = here == h[live]
            found[live[hit]] = self.order[place[live[hit]]]
            live = live[here < h[live]]
            place[live] += 1
            live = live[place[live] < end[live]]
        return found

    def _learn(self, words: list[str], h: np.ndarray) -> None:
        """Adds words; ``h``: their hashes, sorted."""
        # Words of a space and letters can be encoded in one string: the library parts them at each space.
        plain = [i for i, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        added: list[int] = []
        ids: list[int] = []
        n: list[np.ndarray] = []
        for s in range(0, len(plain), 2000):
            some = plain[s : s + 2000]
            got = self.library.encode("".join([words[i] for i in some]), add_special_tokens=False)
            each = np.bincount(np.array(got.word_ids))
            if len(each) == len(some):  # else the library knows a character otherwise: one by one then
                added += some
                ids += got.ids
                n.append(each)
        rest = sorted(set(range(len(words))).difference(added))
        for s in range(0, len(rest), 2000):
            some = rest[s : s + 2000]
            got = [e.ids for e in self.library.encode_batch([words[i] for i in some], add_special_tokens=False)]
            added += some
            for x in got:
                ids += x
            n.append(np.array([len(x) for x in got]))
        n = np.concatenate(n)
        size = np.array([len(words[i]) for i in added], np.int64)
        number = np.empty(len(words), np.int32)
        number[added] = len(self.at) + np.arange(len(words))
        place = np.searchsorted(self.hashes, h)
        hashes = np.insert(self.hashes, place, h)
        first = np.searchsorted(hashes, np.arange(1 << 18, dtype=np.uint64) << U64(46))
        chars = np.frombuffer("".join([words[i] for i in added]).encode("utf-32-le"), np.uint32)
        self.at, self.size, self.chars, self.start, self.n, self.flat, self.hashes, self.order, self.first = (
            np.concatenate([self.at, len(self.chars) + np.cumsum(size) - size]),
            np.concatenate([self.size, size.astype(np.int32)]),
            np.concatenate([self.chars, chars]),
            np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n]),
            np.concatenate([self.n, n.astype(np.int32)]),
            np.concatenate([self.flat, np.array(ids, np.uint16)]),
            hashes,
            np.insert(self.order, place, number),
            np.append(first, len(hashes)).astype(np.int32),
        )

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        special = [i for i, t in enumerate(texts) if SPECIAL in t]
        held = {i: np.array([*self.library.encode(texts[i], add_special_tokens=False).ids, END], np.uint16) for i in special}
        whole = "".join("" if i in held else t for i, t in enumerate(texts)) if held else "".join(texts)
        ends = np.cumsum([0 if i in held else len(t) for i, t in enumerate(texts)])
        if not whole:
            ids, count = np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        else:
            ids, count = self._encoded(whole, ends)
        stops = np.cumsum(count)
        if not held:  # the end ids go behind each text
            return np.insert(ids, stops, np.uint16(END)), count + 1
        found = [held[i] if i in held else np.append(x, np.uint16(END)) for i, x in enumerate(np.split(ids, stops[:-1]))]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _encoded(self, whole: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        cut = np.flatnonzero(self._cuts(code, ends))
        at, size = cut[:-1], np.diff(cut)
        h = self._hashes(code, at, size)
        which = self._find(h)
        if len(unknown := np.flatnonzero(which < 0)):
            if len(self.at) > self.keep:
                self._clear()
                unknown = np.arange(len(h))
            new, first = np.unique(h[unknown], return_index=True)
            first = unknown[first]
            self._learn([whole[a : a + n] for a, n in zip(at[first].tolist(), size[first].tolist())], new)
            which[unknown] = self._find(h[unknown])
        # Character by character: each word is the known one of its hash.
        same = self.size[which] == size
        if same.all():
            known = self.chars[np.arange(len(code)) + np.repeat(self.at[which] - at, size)]
            same = np.logical_and.reduceat(known == code, at)
        n, start = self.n[which].astype(np.int64), self.start[which]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(int(stop[-1])) + np.repeat(start - (stop - n), n)]
        text = np.searchsorted(ends, at, "right")
        if not same.all():  # a collision: those words by the library
            parts = np.split(ids, stop[:-1])
            for i in np.flatnonzero(~same).tolist():
                parts[i] = np.array(self.library.encode(whole[at[i] : at[i] + size[i]], add_special_tokens=False).ids, np.uint16)
            ids, n = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, np.bincount(text, weights=n, minlength=len(ends)).astype(np.int64)


_HELD: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The process's own encoder: a worker that runs many tasks learns a word once."""
    if path not in _HELD:
        _HELD[path] = Tokens(path)
    return _HELD[path]


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to 2**SCALE in sum; every id that occurs keeps at least 1."""
    total, seen = int(counts.sum()), counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    f = np.where(seen, np.maximum(1, counts.astype(np.float64) * ((1 << SCALE) - int(seen.sum())) / total), 0).astype(np.int64)
    over = int(f.sum()) - (1 << SCALE)
    for i in np.argsort(-f, kind="stable").tolist():  # one pass or less: rounding is far below the largest
        if not over:
            break
        take = min(over, int(f[i]) - 1) if over > 0 else over
        f[i] -= take
        over -= take
    return f


class Coder:
    def __init__(self, freq: np.ndarray) -> None:
        self.f = freq.astype(np.uint64)
        self.c = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    @staticmethod
    def _lanes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of blocks with n ids: states of each, the block of each state, its number there."""
        k = -(-n // LANE)
        owner = np.repeat(np.arange(len(n)), k)
        return k, owner, np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        n = np.array([len(b) for b in blocks], np.int64)
        k, owner, lane = self._lanes(n)
        flat, base = np.concatenate(blocks), (np.cumsum(n) - n)[owner]
        steps = -(-(n[owner] - lane) // k[owner])  # ids of each state
        last = int(steps.max())
        x = np.full(len(owner), LOW, np.uint64)
        words, out = np.zeros((last, len(owner)), np.uint32), np.zeros((last, len(owner)), bool)
        for t in range(last - 1, -1, -1):
            live = np.flatnonzero(steps > t)
            s = flat[base[live] + t * k[owner[live]] + lane[live]]
            f, now = self.f[s], x[live]
            full = now >= f << U64(63 - SCALE)
            words[t, live] = (now & U64(0xFFFFFFFF)).astype(np.uint32)
            out[t, live] = full
            now = np.where(full, now >> U64(32), now)
            many = now // f
            x[live] = (many << U64(SCALE)) + (now - many * f) + self.c[s]
        first = np.cumsum(k) - k
        states = x.astype("<u8")
        return [states[a : a + m].tobytes() + words[:, a : a + m][out[:, a : a + m]].astype("<u4").tobytes() for a, m in zip(first.tolist(), k.tolist())]

    def decode(self, blocks: list[bytes], n: np.ndarray) -> list[np.ndarray]:
        n = np.asarray(n, np.int64)
        k, owner, lane = self._lanes(n)
        first = np.cumsum(k) - k
        x = np.frombuffer(b"".join(b[: 8 * m] for b, m in zip(blocks, k.tolist())), "<u8").astype(np.uint64)
        tails = [b[8 * m :] for b, m in zip(blocks, k.tolist())]
        words = np.frombuffer(b"".join(tails), "<u4").astype(np.uint64)
        size = np.array([len(b) // 4 for b in tails], np.int64)
        at = np.cumsum(size) - size
        flat, base = np.zeros(int(n.sum()), np.uint16), (np.cumsum(n) - n)[owner]
        steps = -(-(n[owner] - lane) // k[owner])
        mask = U64((1 << SCALE) - 1)
        for t in range(int(steps.max())):
            live = np.flatnonzero(steps > t)
            now = x[live]
            low = now & mask
            s = self.slot[low.astype(np.int64)]
            flat[base[live] + t * k[owner[live]] + lane[live]] = s
            now = self.f[s] * (now >> U64(SCALE)) + low - self.c[s]
            need = np.zeros(len(owner), bool)
            need[live] = now < LOW
            x[live] = now
            if need.any():
                run = np.concatenate([[0], np.cumsum(need)])
                want = np.flatnonzero(need)
                x[want] = x[want] << U64(32) | words[at[owner[want]] + run[want] - run[first[owner[want]]]]
                at += run[first + k] - run[first]
        if (x != LOW).any() or (at != np.cumsum(size)).any():
            raise ValueError("a block is damaged")
        return np.split(flat, np.cumsum(n)[:-1])


def _batches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(sizes):
        j, n = i, 0
        while j < len(sizes) and (j == i or n + sizes[j] <= most):
            n += sizes[j]
            j += 1
        yield i, j
        i = j


def _binary(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """Stretches of ``flat`` with n items each as a binary column, without a copy for each."""
    at = np.concatenate([[0], np.cumsum(n)]) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


# --- Spark -----------------------------------------------------------------------------------------


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """kind 0: doc_id, n and ids (little-endian, 16 bits); kind 1: the counts of a stretch of input."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = tokens_of(path), np.zeros(1 << 16, np.int64)
        names = ["kind", "doc_id", "n", "ids"]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in _batches([len(t) for t in texts], 1_500_000):
                ids, n = tokens.encode(texts[i:j])
                counts += np.bincount(ids, minlength=len(counts))
                cols = [pa.array([0] * (j - i), pa.int32()), batch.column(0).slice(i, j - i), pa.array(n), _binary(ids.astype("<u2"), n)]
                yield pa.RecordBatch.from_arrays(cols, names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([int(counts.sum())]), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    small = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return small.mapInArrow(run, "kind int, doc_id long, n long, ids binary")


def shared_table(encoded: DataFrame) -> np.ndarray:
    """The frequencies of all ids: one row of counts a task, summed as (id, count) rows; 65,536 rows at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = encoded.filter("kind = 1").select("ids").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << 16, np.int64)
    total[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return frequencies(total)


def write_files(encoded: DataFrame, folder: str, freq: np.ndarray, ranges: int) -> DataFrame:
    """Codes and writes; the manifest: part, file, docs and ids, a row a file."""
    spark = encoded.sparkSession
    rows = encoded.filter("kind = 0").select("doc_id", "n", "ids")
    # Ranges of about equal numbers of documents; their bounds are that many numbers.  A document without an
    # id comes before all others, in a part of its own.
    marks = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, marks)), F.lit(20 * ranges)).alias("b")).first().b if marks else None
    bounds = np.array(sorted(set(found or [])), np.int64)
    held = spark.sparkContext.broadcast(freq)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(2)]
            for i, j in _batches([len(x) for x in ids], 2_000_000):
                some = ids[i:j]
                own = batch.column(0).slice(i, j - i)
                part = np.where(own.is_null().to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(bounds, own.fill_null(0).to_numpy(), "left"))
                cols = [pa.array(part, pa.int32()), batch.column(0).slice(i, j - i), pa.array([len(x) for x in some], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in some], pa.int64()), pa.array(coder.encode(some), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "n", "crc", "block"])

    coded = rows.mapInArrow(code, "part int, doc_id long, n long, crc long, block binary")
    dealt = coded.repartitionById(len(bounds) + 2, "part").sortWithinPartitions("part", "doc_id", "n", "crc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        now, out, name, at, entries = None, None, "", 0, []
        done: list[tuple] = []

        def close() -> None:
            if out is None:
                return
            index = np.array(entries, ENTRY).tobytes()
            out.write(index)
            out.write(struct.pack("<QII", at, len(entries), zlib.crc32(index)) + MAGIC)
            out.close()
            done.append((now, name, len(entries), sum(e[3] for e in entries)))

        for batch in batches:
            for part, doc_id, n, crc, block in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    close()
                    now, name, at, entries = part, f"{uuid.uuid4().hex}.rans", len(MAGIC), []
                    out = fs.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC)
                out.write(block)
                entries.append((doc_id or 0, doc_id is None, at, n, crc))
                at += len(block)
        close()
        cols = list(zip(*done)) or [[]] * 4
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "file", "docs", "ids"])

    return dealt.mapInArrow(write, "part int, file string, docs long, ids long")


def read_files(manifest: DataFrame, folder: str, freq: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and the CRC32 of the ids, from the files that ``manifest`` names."""
    spark = manifest.sparkSession
    held = spark.sparkContext.broadcast(freq)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        fs, base = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['file']}") as file:
                    size = file.size()
                    file.seek(size - 24)
                    foot = file.read(24)
                    stop, count, crc = struct.unpack("<QII", foot[:16])
                    file.seek(stop)
                    index = file.read(count * ENTRY.itemsize)
                    if foot[16:] != MAGIC or zlib.crc32(index) != crc:
                        raise ValueError(f"{row['file']} is damaged")
                    index = np.frombuffer(index, ENTRY)
                    start = row["before"] + np.cumsum(index["n"].astype(np.int64)) - index["n"]
                    ends = np.append(index["at"][1:], np.uint64(stop)).astype(np.int64)
                    for i, j in _batches(index["n"].tolist(), 2_000_000):
                        at = index["at"][i:j].astype(np.int64)
                        file.seek(int(at[0]))
                        raw = file.read(int(ends[j - 1] - at[0]))
                        ids = coder.decode([raw[a - at[0] : b - at[0]] for a, b in zip(at, ends[i:j])], index["n"][i:j])
                        sums = np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], np.int64)
                        if (sums != index["crc"][i:j]).any():
                            raise ValueError(f"{row['file']}: a block's ids do not match their checksum")
                        cols = [pa.array(index["doc_id"][i:j], pa.int64(), mask=index["null"][i:j] > 0), pa.array(start[i:j], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums)]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # The manifest has a row a file; the ids before each are summed over it.
    files = sorted(manifest.collect(), key=lambda r: r.part)
    before, rows = 0, []
    for f in files:
        rows.append((f.file, before))
        before += f.ids
    listed = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)))
    return listed.mapInArrow(read, RESULT)


def token_files(docs: DataFrame, path: str | None = None) -> tuple[DataFrame, str, np.ndarray]:
    """Writes the files of ``docs``; their manifest, their folder and the shared table."""
    spark = docs.sparkSession
    temp, folder = scratch(spark, "token-ids"), scratch(spark, "token-files")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "1000")  # long texts: a batch of them, its copy and its words are held at once
    try:
        encode_documents(docs, path).write.option("compression", "zstd").parquet(temp)
    finally:
        spark.conf.set(rows, before)
    encoded = spark.read.schema("kind int, doc_id long, n long, ids binary").parquet(temp)
    freq = shared_table(encoded)
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/table.bin") as out:
        out.write(freq.astype("<u4").tobytes())
    # A file holds some 64 million ids, so that no task grows with the table.
    total = encoded.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_IDS))
    listed = f"{folder}/manifest"
    write_files(encoded, folder, freq, ranges).write.parquet(listed)
    where, at = opened(temp)
    where.delete_dir(at)
    return spark.read.schema("part int, file string, docs long, ids long").parquet(listed), folder, freq


def op5_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder, freq = token_files(table(spark, sf_dir, "documents"))
    return read_files(manifest, folder, freq)
