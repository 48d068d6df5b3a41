"""Media columns: content-addressed payloads in tar shards.

``write_shards`` turns every text into a byte payload, stores it losslessly as an 8-bit greyscale PNG in a
tar shard in the shared folder and returns one index row per document: digest, shard, offset and length.
Within a shard a payload is stored once, under its SHA-256, whatever the number of rows that hold it.
``header_columns`` fills metadata columns from the tar header and the PNG header alone, by range reads of
545 bytes.  ``read_payloads`` reads whole members, checks them against their digest and header columns, and
computes features.  Both run over the same dealing of the index, one after the other.

No row is shuffled on the way to the shards, so the payloads are written once and cross no network.

Defined results
---------------
* null text: as the empty text; it and the empty text have 0 bytes and a payload of 64 zero bytes.
* a length that is a multiple of 64 (over 0) gets no padding.
* null doc_id: the row is kept, its doc_id is null.
* repeated rows: a row each, with equal values; the payload is stored once in a shard.
* empty table: no rows.  Only doc_id and text are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import opened, scratch, stored, table

UNIT = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = 512 + len(SIGNATURE) + 25  # tar header, signature, IHDR chunk
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
HEADERS = INDEX + ", media_bytes long, width long, height long, payload_bytes long"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The unpadded length and the padded payload of a text."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit greyscale PNG, 64 samples a line."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # the first byte of a line names its filter: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 2)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, UNIT + 1)
    if lines[:, 0].any():
        raise ValueError("unknown line filter")
    return lines[:, 1:].tobytes()


def parse_head(head: bytes) -> tuple[int, int, int]:
    """Member size, width and height from a tar header and the first 33 bytes of its PNG."""
    size = tarfile.TarInfo.frombuf(head[:512], "utf-8", "strict").size
    width, height = struct.unpack_from(">II", head, 512 + 16)
    return size, width, height


def feature_of(payload: bytes) -> str:
    """Mean, standard deviation (both by 1,000, rounded down) and a 16-bin histogram of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, at = len(payload), np.arange(256)
    total, square = int(counts @ at), int(counts @ (at * at))
    spread = int(max(0, square * n - total * total) ** 0.5 * 1000 / n)
    return f"{total * 1000 // n}:{spread}:" + ".".join(map(str, counts.reshape(16, 16).sum(1).tolist()))


def write_shards(docs: DataFrame, folder: str, shard_bytes: int = 256 << 20) -> DataFrame:
    """Index rows of ``docs``; running the result writes the shards below ``folder``.

    A shard has a random name and is named only by the rows of the attempt that wrote it, so a repeated
    task leaves an unnamed file at most and never changes a file that rows point to.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out, shard, at, seen = None, "", 0, {}

        def close() -> None:
            if out is not None:
                out.write(b"\0" * 1024)  # end of archive
                out.close()

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, payload = payload_of(text.as_py())
                key = hashlib.sha256(payload).digest()
                if (place := seen.get(key)) is None:
                    if out is None or at >= shard_bytes:
                        close()
                        shard, at, seen = f"{uuid.uuid4().hex}.tar", 0, {}
                        out = fs.open_output_stream(f"{base}/{shard}")
                    media = to_png(payload)
                    info = tarfile.TarInfo(f"{key.hex()}.png")
                    info.size = len(media)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    out.write(media)
                    out.write(b"\0" * (-len(media) % 512))
                    place = seen[key] = (key.hex(), shard, at, 512 + len(media))
                    at += 512 + len(media) + -len(media) % 512
                rows.append((doc_id, n, *place))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        close()

    small = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return small.mapInArrow(write, INDEX)


def by_place(index: DataFrame) -> DataFrame:
    """Index rows dealt so that a task reads a stretch of a shard in order; rows that share a payload stand together."""
    stretch = F.floor(F.col("offset") / (4 << 20))
    n = index.sparkSession.sparkContext.defaultParallelism
    n = max(n, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return index.repartition(n, "shard", stretch).sortWithinPartitions("shard", "offset")


def _each_member(index: DataFrame, folder: str, length, what, schema: str) -> DataFrame:
    """Rows of ``what(row, bytes)`` for every index row, in the order of the rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        name, file, last, found = None, None, None, ()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if file is not None:
                        file.close()
                    name, last = row["shard"], None
                    file = fs.open_input_file(f"{base}/{name}")
                if row["offset"] != last:
                    file.seek(row["offset"])
                    last, found = row["offset"], what(row, file.read(length(row)))
                rows.append({**row, **found})
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)
        if file is not None:
            file.close()

    return index.mapInArrow(read, schema)


def header_columns(index: DataFrame, folder: str) -> DataFrame:
    """The index with media_bytes, width, height and payload_bytes, by range reads of the headers alone."""

    def what(row: dict, head: bytes) -> dict:
        size, width, height = parse_head(head)
        return {"media_bytes": size, "width": width, "height": height, "payload_bytes": width * height}

    return _each_member(index, folder, lambda row: HEAD, what, HEADERS)


def read_payloads(headed: DataFrame, folder: str) -> DataFrame:
    """Each document's payload, read back and checked against digest and header columns, as digests and features."""

    def what(row: dict, member: bytes) -> dict:
        media = member[512:]
        payload = from_png(media)
        digest = hashlib.sha256(payload).hexdigest()
        if digest != row["digest"] or row["media_bytes"] != len(media) or row["payload_bytes"] != len(payload):
            raise ValueError(f"{row['shard']} at {row['offset']}: the payload is not {row['digest']}")
        return {"payload_sha256": digest, "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(payload)}

    return _each_member(headed, folder, lambda row: row["length"], what, READ)


def media_columns(docs: DataFrame) -> tuple[DataFrame, str]:
    """Stores the payloads of ``docs``; the stored index and the folder of the shards."""
    folder = scratch(docs.sparkSession, "media")
    return stored(write_shards(docs, folder), "media-index"), folder


def op10_media_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = media_columns(table(spark, sf_dir, "documents"))
    return read_payloads(header_columns(by_place(index), folder), folder)
