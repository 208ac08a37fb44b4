"""Log files: Python data sources that read and write framed records, file headers and bucket metadata.

Layout: <root>/<instance>/<bucket>/wal/<file offset>, a header of 4 KiB (read position, upload position,
update time as little-endian longs) and then the blocks; <root>/<instance>/<bucket>/bucketMeta. All paths
go through pyarrow file systems, so a root may be in any store these know.
"""

from __future__ import annotations

import contextlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarry.functions.frames import ALIGN, FILE_HEADER_BYTES, HEADER_BYTES, MAGIC, PAD_MAGIC

META = struct.Struct("<iiqii")


def open_root(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def _files(root: str) -> list[tuple[str, str, str, int, int]]:
    """(instance, bucket, path, offset, size) of each log file, in order of bucket and offset."""
    from pyarrow import fs as pafs

    fs, path = open_root(root)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    out = []
    for f in found:
        parts = f.path[len(path) :].strip("/").split("/")
        if f.type == pafs.FileType.File and len(parts) == 4 and parts[2] == "wal" and parts[3].isdigit():
            out.append((parts[0], parts[1], f.path, int(parts[3]), f.size))
    return sorted(out, key=lambda x: (x[0], x[1], x[3]))


def frames_of(body: bytes, start: int, end: int, block_bytes: int) -> Iterator[tuple[int, int, int, int, bytes, bool]]:
    """(block, pos, len, crc, payload, valid): a block ends at the first word that isn't the magic number, or at
    the first frame that fails its length or CRC, which is given once with valid false."""
    for at in range(start - start % block_bytes, min(end, len(body)), block_bytes):
        pos, stop = max(0, start - at), min(block_bytes, len(body) - at, end - at)
        while pos + HEADER_BYTES <= stop:
            magic, crc, size = struct.unpack_from("<iii", body, at + pos)
            if magic != MAGIC:
                break
            fits = 0 <= size <= stop - pos - HEADER_BYTES
            payload = bytes(body[at + pos + HEADER_BYTES : at + pos + HEADER_BYTES + size]) if fits else b""
            ok = fits and zlib.crc32(payload) == crc & 0xFFFFFFFF
            yield at // block_bytes, pos, size, crc, payload, ok
            if not ok:
                break
            pos += (HEADER_BYTES + size + ALIGN - 1) & -ALIGN


class FilePartition(InputPartition):
    """A log file, or its bytes from ``start`` to ``end`` (without the header)."""

    def __init__(self, instance: str, bucket: str, path: str, offset: int, start: int = 0, end: int = 1 << 62):
        self.instance, self.bucket, self.path, self.offset, self.start, self.end = instance, bucket, path, offset, start, end


class FilesPartition(InputPartition):
    """Several of them, read by one task one after the other: a task costs far more than a small file does."""

    def __init__(self, parts: list[FilePartition]):
        self.parts = parts


def _grouped(parts: Iterable[tuple[FilePartition, int]], limit: int) -> list[FilesPartition]:
    """Parts, each with its cost, in order, in groups of up to ``limit``; one that costs more stands alone."""
    out, group, held = [], [], 0
    for part, cost in parts:
        if group and held + cost > limit:
            out.append(FilesPartition(group))
            group, held = [], 0
        group.append(part)
        held += cost
    return [*out, FilesPartition(group)]


class FramesReader(DataSourceReader):
    """Pieces of whole blocks, up to SPLIT bytes of a file, those of small files in groups of GROUP bytes, so that tasks grow
    with the bytes and not with the files; a task holds one block and a batch of BATCH bytes at a time and gives Arrow batches.

    mode: DROPMALFORMED (default), PERMISSIVE (invalid frames as rows), FAILFAST. range: all, or recovery (files whose
    upload is behind; from upload to read position). bucket, file and block: only these are listed and read, to scan a
    single block again.
    """

    SPLIT, GROUP, OPEN, BATCH = 64 << 20, 16 << 20, 64 << 10, 1 << 20  #: OPEN: what opening a file counts as, at least

    def __init__(self, options: dict):
        self.root, self.block_bytes = options["path"], int(options["block_bytes"])
        self.mode, self.range = options.get("mode", "DROPMALFORMED").upper(), options.get("range", "all")
        self.bucket, self.file, self.block = options.get("bucket"), options.get("file"), options.get("block")

    def partitions(self) -> list[FilesPartition]:
        out, step = [], max(1, self.SPLIT // self.block_bytes) * self.block_bytes
        for instance, bucket, path, offset, size in _files(self.root):
            if self.bucket not in (None, bucket) or (self.file is not None and int(self.file) != offset):
                continue
            if self.block is not None:
                out.append((FilePartition(instance, bucket, path, offset, int(self.block) * self.block_bytes, (int(self.block) + 1) * self.block_bytes), self.block_bytes))
                continue
            out += [(FilePartition(instance, bucket, path, offset, at, at + step), max(self.OPEN, min(step, size - FILE_HEADER_BYTES - at))) for at in range(0, size - FILE_HEADER_BYTES, step)]
        return _grouped(out, self.GROUP)

    def read(self, partition: FilesPartition):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        names = ["instance", "bucket", "file_from_offset", "block_index", "wal_pos", "len", "crc", "payload", "valid"]
        rows, held = [], 0
        for of_block, size in self._blocks(partition):
            rows += of_block
            held += size
            if held >= self.BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def _blocks(self, partition: FilesPartition) -> Iterator[tuple[list[tuple], int]]:
        """The rows of each block that has any, and its bytes."""
        fs, _ = open_root(self.root)
        for p in partition.parts:
            with fs.open_input_file(p.path) as f:
                read, upload, _ = struct.unpack_from("<qqq", f.read_at(FILE_HEADER_BYTES, 0))
                start, end = p.start, min(p.end, f.size() - FILE_HEADER_BYTES)
                if self.range == "recovery":
                    start, end = max(start, upload), min(end, read)
                for at in range(start - start % self.block_bytes, end, self.block_bytes):
                    body = f.read_at(min(self.block_bytes, end - at), FILE_HEADER_BYTES + at)
                    rows = []
                    for _, pos, size, crc, payload, ok in frames_of(body, max(0, start - at), len(body), self.block_bytes):
                        if not ok and self.mode == "FAILFAST":
                            raise ValueError(f"invalid frame at {p.path}, block {at // self.block_bytes}, {pos}")
                        if ok or self.mode == "PERMISSIVE":
                            rows.append((p.instance, p.bucket, p.offset, at // self.block_bytes, pos, size, crc, payload, ok))
                    if rows:
                        yield rows, len(body)


class FilesWritten(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class FramesWriter(DataSourceWriter):
    """Rows (bucket, file_from_offset, block_index, wal_pos, payload, sealed), sorted by file and place in a
    task. Files are written under a name of the attempt and get their own on commit."""

    def __init__(self, options: dict):
        self.root, self.instance = options["path"], options["instance"]
        self.block_bytes, self.file_bytes = int(options["block_bytes"]), int(options["file_bytes"])
        self.uploaded = int(options.get("upload_position", "0"))

    def write(self, rows) -> FilesWritten:
        fs, path = open_root(self.root)
        moves, key, body, read = [], None, bytearray(), 0

        def finish() -> None:
            if key is None:
                return
            folder = f"{path}/{self.instance}/{key[0]}/wal"
            fs.create_dir(folder, recursive=True)
            name = f"{folder}/.{key[1]}-{uuid.uuid4().hex}"
            with fs.open_output_stream(name) as f:
                f.write(struct.pack("<qqq", read, self.uploaded, 0).ljust(FILE_HEADER_BYTES, b"\0"))
                f.write(bytes(body))
            moves.append((name, f"{folder}/{key[1]}"))

        for r in rows:
            if (r.bucket, r.file_from_offset) != key:
                finish()
                key, body, read = (r.bucket, r.file_from_offset), bytearray(self.file_bytes), 0
            at = r.block_index * self.block_bytes + r.wal_pos
            payload = bytes(r.payload)
            struct.pack_into("<iII", body, at, MAGIC, zlib.crc32(payload), len(payload))
            body[at + HEADER_BYTES : at + HEADER_BYTES + len(payload)] = payload
            end = r.wal_pos + ((HEADER_BYTES + len(payload) + ALIGN - 1) & -ALIGN)
            tail = r.block_index * self.block_bytes + end
            if r.sealed and self.block_bytes - end >= 4:  # a later record of the block overwrites it
                struct.pack_into("<i", body, tail, PAD_MAGIC)
            read = max(read, (r.block_index + 1) * self.block_bytes if r.sealed else tail)
        finish()
        return FilesWritten(moves)

    def commit(self, messages) -> None:
        fs, _ = open_root(self.root)
        with ThreadPoolExecutor(16) as pool:
            for _ in pool.map(lambda x: fs.move(*x), [x for m in messages if m for x in m.moves]):
                pass

    def abort(self, messages) -> None:
        fs, _ = open_root(self.root)
        for m in messages:
            for a, _ in m.moves if m else ():
                fs.delete_file(a)


class WalFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wal_frames"

    def schema(self) -> str:
        return "instance string, bucket string, file_from_offset long, block_index int, wal_pos int, len int, crc int, payload binary, valid boolean"

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options)

    def writer(self, schema, overwrite: bool) -> FramesWriter:
        return FramesWriter(self.options)


class HeadersReader(DataSourceReader):
    """The headers of up to GROUP files in a task."""

    GROUP = 256

    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[FilesPartition]:
        return _grouped(((FilePartition(*f[:4]), 1) for f in _files(self.root)), self.GROUP)

    def read(self, partition: FilesPartition):
        fs, _ = open_root(self.root)
        for p in partition.parts:
            with fs.open_input_file(p.path) as f:
                yield p.instance, p.bucket, p.offset, *struct.unpack("<qqq", f.read(24))


def move_positions(root: str, instance: str, bucket: str, file: int, read: int | None = None, upload: int | None = None) -> tuple[int, int]:
    """Moves a log file's read or upload position on, never back; returns both. In place on a local file system; elsewhere,
    where a file can't be written in part, by a copy that takes its name."""
    from pyarrow import fs as pafs

    fs, path = open_root(root)
    name = f"{path}/{instance}/{bucket}/wal/{file}"
    with fs.open_input_file(name) as f:
        old_read, old_upload, _ = struct.unpack("<qqq", f.read(24))
    new = (max(old_read, read or 0), max(old_upload, upload or 0))
    head = struct.pack("<qqq", *new, time.time_ns() // 1_000_000)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(name, "r+b") as f:
            f.write(head)
        return new
    copy = f"{path}/{instance}/{bucket}/wal/.{file}-{uuid.uuid4().hex}"
    with fs.open_input_stream(name) as f, fs.open_output_stream(copy) as out:
        out.write(head + f.read(FILE_HEADER_BYTES)[24:])
        while part := f.read(8 << 20):
            out.write(part)
    fs.move(copy, name)
    return new


def delete_log(root: str, instance: str, bucket: str, file: int) -> None:
    """Deletes a log file; one that is gone already is no error."""
    fs, path = open_root(root)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_file(f"{path}/{instance}/{bucket}/wal/{file}")


class WalHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wal_headers"

    def schema(self) -> str:
        return "instance string, bucket string, file_from_offset long, read_position long, upload_position long, update_time long"

    def reader(self, schema) -> HeadersReader:
        return HeadersReader(self.options)


def meta_crc(block_size: int, file_size: int, prefix: bytes) -> int:
    """CRC-32 over the whole little-endian values of file size, block size, prefix length and the prefix, signed."""
    crc = zlib.crc32(struct.pack("<qii", file_size, block_size, len(prefix)) + prefix)
    return crc - (1 << 32) if crc >= 1 << 31 else crc


def write_bucket_meta(root: str, instance: str, bucket: str, is_dirty: int, block_size: int, file_size: int, prefix: str) -> None:
    fs, path = open_root(root)
    fs.create_dir(f"{path}/{instance}/{bucket}", recursive=True)
    p = prefix.encode()
    with fs.open_output_stream(f"{path}/{instance}/{bucket}/bucketMeta") as f:
        f.write((META.pack(is_dirty, block_size, file_size, meta_crc(block_size, file_size, p), len(p)) + p).ljust(4096, b"\0"))


def set_dirty(root: str, instance: str, bucket: str, is_dirty: int) -> None:
    """Changes the dirty flag of a bucket's metadata and nothing else; the CRC doesn't cover it."""
    fs, path = open_root(root)
    name = f"{path}/{instance}/{bucket}/bucketMeta"
    with fs.open_input_file(name) as f:
        data = f.read()
    copy = f"{path}/{instance}/{bucket}/.bucketMeta-{uuid.uuid4().hex}"
    with fs.open_output_stream(copy) as f:
        f.write(struct.pack("<i", is_dirty) + data[4:])
    fs.move(copy, name)


class BucketMetaReader(DataSourceReader):
    """A row a bucket with metadata that hold their CRC; no row for missing or damaged ones."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def read(self, partition):
        from pyarrow import fs as pafs

        fs, path = open_root(self.root)
        folders = lambda at: [f.path for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.Directory]
        found = fs.get_file_info([f"{bucket}/bucketMeta" for instance in folders(path) for bucket in folders(instance)])
        for f in found:  # no log file is listed for it
            parts = f.path[len(path) :].strip("/").split("/")
            if f.type != pafs.FileType.File:
                continue
            with fs.open_input_file(f.path) as opened:
                data = opened.read()
            if len(data) < META.size:
                continue
            dirty, block, file, crc, n = META.unpack_from(data)
            prefix = data[META.size : META.size + max(0, n)]
            if len(prefix) == n and crc == meta_crc(block, file, prefix):
                yield parts[0], parts[1], dirty, block, file, prefix.decode()


class BucketMeta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bucket_meta"

    def schema(self) -> str:
        return "instance string, bucket string, is_dirty int, block_size int, file_size long, prefix string"

    def reader(self, schema) -> BucketMetaReader:
        return BucketMetaReader(self.options)


def register(spark) -> None:
    for source in (WalFrames, WalHeaders, BucketMeta):
        spark.dataSource.register(source)
