"""Block objects: a sink that puts one object per row under its key, and their verification.

A put is idempotent: the key follows from the block, and a second put replaces the whole object.
"""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quarry.sources.wal import open_root

ATTEMPTS = 3


def put_object(root: str, key: str, content: bytes) -> None:
    """Writes one object whole: readers see the old one or the new one. Arguments are checked first."""
    if not root or not key or not key.strip("/"):
        raise ValueError("root and key must not be blank")
    if content is None:
        raise ValueError("content must not be null")
    fs, path = open_root(root)
    target = f"{path}/{key}"
    for attempt in range(1, ATTEMPTS + 1):
        try:
            fs.create_dir(posixpath.dirname(target), recursive=True)
            name = f"{posixpath.dirname(target)}/.{uuid.uuid4().hex}"
            try:
                with fs.open_output_stream(name) as f:
                    f.write(content)
                fs.move(name, target)
                return
            except OSError:
                with contextlib.suppress(OSError):
                    fs.delete_file(name)
                raise
        except OSError:
            if attempt == ATTEMPTS:
                raise


class Put(WriterCommitMessage):
    def __init__(self, objects: int):
        self.objects = objects


class ObjectWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, rows) -> Put:
        n = 0
        for r in rows:
            put_object(self.root, r.s3_key, bytes(r.content))
            n += 1
        return Put(n)


class BlockObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_objects"

    def schema(self) -> str:
        return "s3_key string, content binary"

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options)


def register(spark) -> None:
    """Streams need this done before they start: their micro-batches run in a session that is a copy."""
    spark.dataSource.register(BlockObjects)


def write_objects(objects: DataFrame, root: str, uploads: int | None = None) -> None:
    """Puts every object; with ``uploads``, no more than so many at a time."""
    register(objects.sparkSession)
    rows = objects.select("s3_key", "content")
    (rows.repartition(uploads) if uploads else rows).write.format("block_objects").mode("append").save(root)


def read_ranges(receipts: DataFrame, root: str) -> DataFrame:
    """(bucket, seq, s3_key, payload) of successful receipts: range reads of (object_offset, size), an object opened once
    for all of its receipts in a task, never read whole. A missing object or a range beyond its end gives a null payload."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_root(root)
        key, file = None, None
        for b in batches:
            out = []
            for k, at, n in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if k != key:
                    if file:
                        file.close()
                    try:
                        key, file = k, fs.open_input_file(f"{path}/{k}")
                    except FileNotFoundError:
                        file = None
                data = file.read_at(n, at) if file else None
                out.append(data if data is not None and len(data) == n else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["bucket", "seq", "s3_key", "payload"])
        if file:
            file.close()

    rows = receipts.where("is_success").select("bucket", "seq", "s3_key", F.col("object_offset").cast("long").alias("object_offset"), F.col("size").cast("long").alias("size"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("bucket", "seq", "s3_key"))
    return rows.repartition("s3_key").sortWithinPartitions("s3_key", "object_offset").mapInArrow(work, f"{kinds}, payload binary")


def store_options(access_key: str, secret_key: str, endpoint: str, region: str = "us-east-1", path_style: bool = True, attempts: int = ATTEMPTS, timeout_ms: int = 60_000) -> dict[str, str]:
    """Session options for an S3-compatible store under s3a:// paths. Keys and endpoint must not be blank."""
    if not all(x and x.strip() for x in (access_key, secret_key, endpoint, region)):
        raise ValueError("keys, endpoint and region must not be blank")
    options = {"access.key": access_key, "secret.key": secret_key, "endpoint": endpoint, "endpoint.region": region, "path.style.access": str(path_style).lower(), "attempts.maximum": str(attempts), "connection.timeout": str(timeout_ms)}
    return {f"spark.hadoop.fs.s3a.{k}": v for k, v in options.items()}


def read_objects(spark, root: str, content: bool = True) -> DataFrame:
    """(s3_key, length, content) of all objects under root; without content no bytes are read.

    Spark lists no empty files; blocks are never empty, as empty payloads are rejected.
    """
    uri = root if "://" in root else f"file://{root}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.block").load(uri)
    base = uri.split("://", 1)[1].rstrip("/") + "/"
    key = F.substring_index(F.col("path"), base, -1)
    return found.select(key.alias("s3_key"), "length", *(["content"] if content else []))


def verify_uploads(expected: DataFrame, root: str) -> DataFrame:
    """(s3_key, bytes) -> with the stored length and whether it is the expected one."""
    stored = read_objects(expected.sparkSession, root, content=False)
    return expected.select("s3_key", "bytes").join(stored, "s3_key", "left").select("s3_key", "bytes", F.col("length").alias("stored_bytes"), F.coalesce(F.col("length") == F.col("bytes"), F.lit(False)).alias("verified"))
