"""Blocks, pointers, retention, recovery candidates and configuration as relational queries.

Groups are reduced by combinable aggregates; windows run within one block, file or bucket config.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.frames import block_key, object_key, ordered_concat

BLOCK = ["bucket", "file_from_offset", "block_index"]

#: The block states that may follow each state.
TRANSITIONS = {"OPEN": ["SEALED"], "SEALED": ["UPLOADING"], "UPLOADING": ["SUCCESS", "FAILED"], "FAILED": ["UPLOADING"], "SUCCESS": []}
UPLOADED, PAGE_CACHED = 3, 1  #: per-block states of a file: 0 none, 1 durable, 3 uploaded


def object_offsets(packed: DataFrame) -> DataFrame:
    """Adds object_offset: payload bytes before the record in its block's object."""
    before = Window.partitionBy(*BLOCK).orderBy("wal_pos").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("object_offset", F.when(F.col("status") == "PUT_OK", F.coalesce(F.sum("len").over(before), F.lit(0))))


def write_receipts(placed: DataFrame, prefix: str, machine: str, instance: str) -> DataFrame:
    """(bucket, seq, s3_key, object_offset, size, is_success, status); failures carry -1."""
    ok = F.col("status") == "PUT_OK"
    key = object_key(F.lit(prefix), machine, instance, "bucket", "file_from_offset", "block_index")
    return placed.select("bucket", "seq", F.when(ok, key).alias("s3_key"), F.when(ok, F.col("object_offset")).otherwise(-1).alias("object_offset"), F.when(ok, F.col("len")).otherwise(-1).alias("size"), ok.alias("is_success"), "status")


def block_manifest(placed: DataFrame, block_bytes: int, wal_ok: Column | None = None, block_ok: Column | None = None, ts: str | None = None, idle_us: int | None = None) -> DataFrame:
    """One row a block: counts, bytes, state. The last block of a bucket is open, all others are sealed.

    ``sealed_by`` is IDLE where, by the timestamps ``ts``, the next block begins over ``idle_us`` after this one's last
    record, or else SIZE. Blocks meet the next ones by (bucket, block), so that no task has all of a bucket.
    """
    wal = wal_ok if wal_ok is not None else F.lit(True)
    done = wal & (block_ok if block_ok is not None else F.lit(True))
    time = F.col(ts) if ts else F.lit(None).cast("timestamp")
    rows = placed.where("status = 'PUT_OK'").groupBy(*BLOCK, "block").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("len").alias("expected_bytes"),
        F.coalesce(F.sum(F.when(wal, F.col("len"))), F.lit(0)).alias("page_cache_bytes"),
        F.coalesce(F.sum(F.when(done, F.col("len"))), F.lit(0)).alias("finished_bytes"),
        F.sum("framed_size").alias("framed_bytes"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.max(~done).alias("is_broken"),
        F.min(time).alias("first_ts"),
        F.max(time).alias("last_ts"),
    )
    after = rows.select("bucket", (F.col("block") - 1).alias("block"), F.lit(True).alias("sealed"), F.col("first_ts").alias("next_ts"))
    idle = F.timestamp_diff("MICROSECOND", F.col("last_ts"), F.col("next_ts")) > idle_us if idle_us is not None else F.lit(False)
    sealed = F.col("sealed").isNotNull()
    return rows.join(after, ["bucket", "block"], "left").select(
        *BLOCK, "records", "expected_bytes", "page_cache_bytes", "finished_bytes", "framed_bytes", "first_seq", "last_seq", "last_ts", "is_broken",
        F.when(sealed, F.lit(block_bytes) - F.col("framed_bytes")).otherwise(0).alias("pad_bytes"),
        F.when(sealed, "SEALED").otherwise("OPEN").alias("state"),
        F.when(sealed & F.coalesce(idle, F.lit(False)), "IDLE").when(sealed, "SIZE").otherwise("NONE").alias("sealed_by"),
    )


def _seal(manifest: DataFrame, which: Column, block_bytes: int, cause: str) -> DataFrame:
    now = (F.col("state") == "OPEN") & which
    return manifest.withColumns({"pad_bytes": F.when(now, F.lit(block_bytes) - F.col("framed_bytes")).otherwise(F.col("pad_bytes")), "state": F.when(now, "SEALED").otherwise(F.col("state")), "sealed_by": F.when(now, cause).otherwise(F.col("sealed_by"))})


def seal_idle(manifest: DataFrame, as_of: Column, max_idle_us: int, block_bytes: int) -> DataFrame:
    """Seals open blocks last written over the limit before ``as_of``, though no record follows."""
    return _seal(manifest, F.coalesce(F.timestamp_diff("MICROSECOND", F.col("last_ts"), as_of) > max_idle_us, F.lit(False)), block_bytes, "IDLE")


def seal_all(manifest: DataFrame, block_bytes: int) -> DataFrame:
    """Seals every open block: nothing more is written."""
    return _seal(manifest, F.lit(True), block_bytes, "CLOSE")


def is_sealed(manifest: DataFrame) -> DataFrame:
    """Each block by its place and its key, and whether it is sealed."""
    return manifest.select("bucket", "file_from_offset", "block_index", block_key("file_from_offset", "block_index").alias("block_key"), (F.col("state") == "SEALED").alias("is_sealed"))


def dirty_buckets(manifest: DataFrame, acked: DataFrame) -> DataFrame:
    """(bucket, is_dirty): whether a block of the bucket isn't acknowledged yet."""
    done = acked.select(*BLOCK).distinct().withColumn("acked", F.lit(True))
    return manifest.join(done, BLOCK, "left").groupBy("bucket").agg(F.max(F.col("acked").isNull()).alias("is_dirty"))


def more_uploads(states: DataFrame, by: list[str], state: str, total_blocks: int) -> DataFrame:
    """Files of which fewer blocks are acknowledged than they hold."""
    return states.groupBy(*by).agg(F.count(F.when(F.col(state) == UPLOADED, 1)).alias("acked_blocks")).withColumn("more", F.col("acked_blocks") < total_blocks)


def counters(manifest: DataFrame) -> DataFrame:
    """Per bucket: blocks open and sealed, those that wait for their upload, are broken, or can't finish it."""
    sealed, whole = F.col("state") == "SEALED", F.col("page_cache_bytes") == F.col("finished_bytes")
    n = lambda c: F.count(F.when(c, 1))
    return manifest.groupBy("bucket").agg(n(~sealed).alias("open"), n(sealed).alias("sealed"), n(sealed & whole).alias("queued"), n(sealed & ~whole).alias("dead"), n(F.col("is_broken")).alias("broken"), F.sum("expected_bytes").alias("bytes"))


def consume_dead_letters(dead: DataFrame, frames: DataFrame) -> DataFrame:
    """The records of dead-lettered blocks as the log has them, for whoever takes them on."""
    return frames.where("valid").join(dead.select("s3_key", *BLOCK), BLOCK).select("s3_key", *BLOCK, "wal_pos", "payload")


def acknowledge(states: DataFrame, acks: DataFrame, by: list[str], state: str) -> DataFrame:
    """States with acknowledged blocks (keys ``by``) as uploaded, so that the pointer moves past them."""
    done = acks.select(*by).distinct().withColumn("__acked", F.lit(True))
    return states.join(done, by, "left").withColumn(state, F.when(F.col("__acked"), UPLOADED).otherwise(F.col(state))).drop("__acked")


def uploadable(manifest: DataFrame) -> DataFrame:
    return manifest.where((F.col("state") == "SEALED") & (F.col("page_cache_bytes") == F.col("finished_bytes")))


def read_ready(manifest: DataFrame) -> DataFrame:
    return manifest.where((F.col("state") == "SEALED") & (F.col("expected_bytes") == F.col("page_cache_bytes")))


def recover_tasks(manifest: DataFrame) -> DataFrame:
    """Blocks to recover: sealed and broken, once each."""
    return manifest.where((F.col("state") == "SEALED") & F.col("is_broken")).select(*BLOCK).distinct()


def dead_letters(manifest: DataFrame, prefix: str, machine: str, instance: str) -> DataFrame:
    """Sealed blocks whose upload can't finish, with the key that it would have had."""
    key = object_key(F.lit(prefix), machine, instance, "bucket", "file_from_offset", "block_index")
    failed = (F.col("state") == "SEALED") & (F.col("page_cache_bytes") != F.col("finished_bytes"))
    return manifest.where(failed).select(F.lit(instance).alias("instance"), *BLOCK, key.alias("s3_key"))


def live_blocks(manifest: DataFrame, finished: DataFrame) -> DataFrame:
    """The manifest without blocks that are done with."""
    return manifest.join(finished.select(*BLOCK).distinct(), BLOCK, "left_anti")


def idle_blocks(blocks: DataFrame, as_of: Column, max_idle_us: int) -> DataFrame:
    """Open blocks last written over the limit before ``as_of``."""
    return blocks.where((F.col("state") == "OPEN") & (F.timestamp_diff("MICROSECOND", F.col("last_ts"), as_of) > max_idle_us))


def idle_sessions(events: DataFrame, bucket: str, ts: str, gap: str) -> DataFrame:
    """Runs of records without a gap over the limit; an event at exactly the gap is still in."""
    return events.groupBy(F.col(bucket).alias("bucket"), F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("records"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("s")


def contiguous_prefix(states: DataFrame, by: list[str], index: str, stands: Column, block_bytes: int, failed: Column | None = None) -> DataFrame:
    """Bytes before the first block for which ``stands`` is false, at most up to the first failed one."""
    stop = F.min(F.when(~stands, F.col(index)))
    if failed is not None:
        stop = F.least(stop, F.min(F.when(failed, F.col(index))))
    return states.groupBy(*by).agg((F.coalesce(stop, F.count(F.lit(1))) * F.lit(block_bytes)).cast("long").alias("position"))


def upload_pointer(states: DataFrame, by: list[str], index: str, state: str, block_bytes: int, failed: Column | None = None) -> DataFrame:
    return contiguous_prefix(states, by, index, F.col(state) == UPLOADED, block_bytes, failed)


def read_pointer(states: DataFrame, by: list[str], index: str, state: str, block_bytes: int, failed: Column | None = None) -> DataFrame:
    return contiguous_prefix(states, by, index, F.col(state).isin(PAGE_CACHED, UPLOADED), block_bytes, failed)


def collectable_files(files: DataFrame) -> DataFrame:
    """Files (refs, closed, read_position, upload_position) that may be deleted."""
    return files.where((F.col("refs") == 0) & F.col("closed") & (F.col("read_position") == F.col("upload_position")))


def recovery_candidates(bucket_meta: DataFrame, headers: DataFrame, block_bytes: Column) -> DataFrame:
    """Files to replay: of dirty buckets, in blocks no larger than now, with uploads behind reads."""
    gate = bucket_meta.where((F.col("is_dirty") != 0) & (block_bytes >= F.col("block_size")))
    return headers.where(F.col("read_position") != F.col("upload_position")).join(gate, "bucket")


def resolve_config(buckets: DataFrame, special: DataFrame, default: dict) -> DataFrame:
    """Each bucket's configuration: its special one as a whole, or else the default as a whole."""
    fields = list(default)
    own = special.select("bucket", F.struct(*fields).alias("own"))
    standard = F.struct(*(F.lit(default[f]).cast(special.schema[f].dataType).alias(f) for f in fields))
    return buckets.select("bucket").join(own, "bucket", "left").select("bucket", F.coalesce("own", standard).alias("c")).select("bucket", "c.*")


def check_transitions(states: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Each change of state, and whether it may be made."""
    allowed = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    moves = states.withColumn("from_state", before).where("from_state is not null")
    return moves.select(*by, *order, "from_state", F.col(state).alias("to_state"), F.coalesce(F.array_contains(allowed[F.col("from_state")], F.col(state)), F.lit(False)).alias("allowed"))


def valid_prefix(frames: DataFrame, by: list[str], position: str, valid: Column) -> DataFrame:
    """Frames before the first invalid one of their block."""
    first_bad = F.min(F.when(~valid, F.col(position))).over(Window.partitionBy(*by))
    return frames.withColumn("__bad", first_bad).where(F.col("__bad").isNull() | (F.col(position) < F.col("__bad"))).drop("__bad")


def distinct_tasks(tasks: DataFrame) -> DataFrame:
    """A task queue without duplicates, with block keys."""
    return tasks.dropDuplicates(["file_from_offset", "block_index"]).select("file_from_offset", "block_index", block_key("file_from_offset", "block_index").alias("block_key"))


def concat_blocks(placed: DataFrame, payload: str = "payload") -> DataFrame:
    """The object of each block: its payloads in order. A block bounds what one group holds."""
    return placed.where("status = 'PUT_OK'").groupBy(*BLOCK).agg(ordered_concat("wal_pos", payload).alias("content"))
