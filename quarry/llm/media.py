"""Media columns: content-addressed payloads in tar shards.

``store`` turns each payload into a greyscale PNG of 8-bit samples (lossless) and appends it, named by
the SHA-256 of its payload, to a tar shard in the shared folder, one shard or more per task. Rows carry
digest, shard, offset and length. ``locate`` keeps one place per digest. ``probe`` fills metadata columns
from a range read of the PNG's header alone; ``read_back`` reads whole payloads by range and computes
features of them.

Payload: the text's UTF-8 bytes, then bytes 255 up to a positive multiple of 576, one image row each.

Recovery: a shard's name is new for each attempt of a task and rows name the shard they are in, so shards
of failed attempts are never referred to. A payload is stored once per shard at most; where several shards
hold it, every row is pointed to the least (shard, offset). No text or payload is shuffled.

Defined cases: a null text is the empty text; equal texts have equal values; repeated rows repeat; an
empty table gives no rows and no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.shared import materialize, new_path

ROW = 576
SHARD_BYTES = 64 << 20  #: a task begins another shard beyond this
SEEN = 200_000  #: digests of one shard that a task remembers; beyond, a payload may be stored again
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  #: bytes of signature and IHDR
TAIL = 32


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the bytes before padding."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b"\xff"), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = b"".join(b"\0" + payload[i : i + ROW] for i in range(0, len(payload), ROW))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(payload) // ROW, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows, 1)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample, from the first HEADER bytes."""
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or colour != 0 or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a greyscale PNG")
    return width, height, bits


def from_png(data: bytes) -> bytes:
    width, height, _ = header_of(data[:HEADER])
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    rows = zlib.decompress(b"".join(parts))
    if len(rows) != height * (width + 1) or any(rows[:: width + 1]):
        raise ValueError("unexpected PNG rows")
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


class Shard:
    """A tar file that grows by one member at a time."""

    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.name = f"{uuid.uuid4().hex}.tar"
        self.out, self.at, self.seen = fs.open_output_stream(posixpath.join(folder, self.name)), 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest not in self.seen:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            for part in (head, data, b"\0" * (-len(data) % 512)):
                self.out.write(part)
            if len(self.seen) >= SEEN:
                self.seen.clear()
            self.seen[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.seen[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; returns id, n_bytes, digest, shard, offset, length. Run it once (materialize)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        shard = None
        for batch in batches:
            rows = []
            for text in batch.column(1):
                payload, n = payload_of(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                if shard is None or shard.at > SHARD_BYTES:
                    if shard:
                        shard.close()
                    shard = Shard(fs, path)
                place = shard.seen.get(digest) or shard.add(digest, to_png(payload))
                rows.append((n, digest, shard.name, *place))
            n, digest, name, offset, length = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(name, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=[id_col, "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {id_type}, n_bytes long, digest string, shard string, offset long, length long")


def locate(stored: DataFrame) -> DataFrame:
    """digest -> its one place: the least (shard, offset)."""
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")


def _by_range(places: DataFrame, folder: str, schema: str, row, whole: bool) -> DataFrame:
    """``row(bytes)`` of each place; reads the stored bytes, or no more than the header."""
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if shard != name:
                    if file:
                        file.close()
                    name, file = shard, fs.open_input_file(posixpath.join(path, shard))
                out.append(row(file.read_at(length if whole else min(HEADER, length), offset)))
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if isinstance(c[0] if c else "", str) else pa.int64()) for c in cols)], names=["digest", *names])
        if file:
            file.close()

    spread = places.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")
    return spread.mapInArrow(work, f"digest string, {schema}")


def probe(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits, from range reads of headers alone."""
    return _by_range(places, folder, "width long, height long, bits long", header_of, whole=False)


def features(data: bytes) -> tuple[int, str, int, int, str, str]:
    """Of the stored bytes: payload size, hash, CRC of its tail, stored size, hash, and a feature string."""
    payload = from_png(data)
    width, height, bits = header_of(data[:HEADER])
    total = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), f"png:{width}x{height}x{bits}:mean={total / len(payload):.6f}"


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored bytes."""
    return _by_range(places, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", features, whole=True)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its place in the shards, header metadata and features read back."""
    folder = new_path(docs.sparkSession, "media-shards")
    stored = materialize(store(docs, folder, id_col, text_col), "media-index")
    places = materialize(locate(stored), "media-places")
    known = places.join(probe(places, folder), "digest").join(read_back(places, folder), "digest")
    return stored.select(id_col, "n_bytes", "digest").join(known, "digest")
