"""Recovery of log files after a crash: replay what was durable and not yet uploaded, under its old key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.frames import object_key, ordered_concat
from quarry.operators.manifest import collectable_files, recovery_candidates
from quarry.sources.wal import delete_log, move_positions, register, set_dirty


def replay(spark: SparkSession, root: str, block_bytes: int, machine: str) -> DataFrame:
    """(instance, bucket, file_from_offset, block_index, s3_key, content) of each block to upload again.

    Buckets must be dirty and have had blocks no larger than now; files are read from their upload to their
    read position, each block up to its first invalid frame. Keys have the prefix in the bucket's metadata.
    """
    register(spark)
    meta = spark.read.format("bucket_meta").option("path", root).load().drop("instance")
    headers = spark.read.format("wal_headers").option("path", root).load()
    files = recovery_candidates(meta, headers, F.lit(block_bytes)).select("bucket", "file_from_offset", "prefix")
    frames = spark.read.format("wal_frames").option("path", root).option("block_bytes", block_bytes).option("range", "recovery").load()
    blocks = frames.where("valid").join(files, ["bucket", "file_from_offset"]).groupBy("instance", "bucket", "file_from_offset", "block_index", "prefix").agg(ordered_concat("wal_pos", "payload").alias("content"), F.count(F.lit(1)).alias("records"))
    key = object_key("prefix", machine, F.col("instance"), "bucket", "file_from_offset", "block_index")
    return blocks.select("instance", "bucket", "file_from_offset", "block_index", "records", key.alias("s3_key"), "content")


def for_each(rows: DataFrame, columns: list[str], act) -> int:
    """``act`` on each row, on the executors; returns how many there were. Acts must bear being repeated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                act(*row)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select(*columns).mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def commit(spark: SparkSession, root: str, block_bytes: int) -> None:
    """After all that replay() gave is uploaded: upload positions move up to the read positions, then the buckets whose
    files are all done are no longer dirty. A second replay finds nothing."""
    register(spark)
    meta = spark.read.format("bucket_meta").option("path", root).load()
    headers = spark.read.format("wal_headers").option("path", root)
    files = recovery_candidates(meta.drop("instance"), headers.load(), F.lit(block_bytes))
    for_each(files, ["instance", "bucket", "file_from_offset", "read_position"], lambda i, b, f, read: move_positions(root, i, b, f, upload=read))
    behind = headers.load().where("read_position > upload_position").select("instance", "bucket").distinct()
    clean = meta.where("is_dirty <> 0").join(behind, ["instance", "bucket"], "left_anti")
    for_each(clean, ["instance", "bucket"], lambda i, b: set_dirty(root, i, b, 0))


def collect_files(spark: SparkSession, root: str, refs: DataFrame | None = None) -> int:
    """Deletes log files that are closed (their bucket has a later one), fully uploaded and, by ``refs`` (bucket,
    file_from_offset, refs), not in use; returns how many."""
    register(spark)
    headers = spark.read.format("wal_headers").option("path", root).load()
    last = headers.groupBy("instance", "bucket").agg(F.max("file_from_offset").alias("last"))
    files = headers.join(last, ["instance", "bucket"]).withColumn("closed", F.col("file_from_offset") < F.col("last"))
    files = files.join(refs, ["bucket", "file_from_offset"], "left").withColumn("refs", F.coalesce("refs", F.lit(0))) if refs is not None else files.withColumn("refs", F.lit(0))
    return for_each(collectable_files(files), ["instance", "bucket", "file_from_offset"], lambda i, b, f: delete_log(root, i, b, f))
