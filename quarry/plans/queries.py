"""The registered queries of the block engine and their SQL.

Records: documents, bucket = source, seq = doc_id, payload = text; events, bucket = event_type, ordered by
(ts, event_id), payload = props. Other tables stand in for configuration, pointers and outcomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import frames as fr
from quarry.operators import manifest as mf
from quarry.operators.pack import pack, roll_files, with_status
from quarry.plans import recover
from quarry.plans.shared import materialize, new_path
from quarry.sources import objects as ob
from quarry.sources import wal
from quarry.streaming import blocks as st
from quarry.streaming import upload as up

B, W = 65_536, 262_144
EVENT_B, EVENT_W, IDLE_US = 4_096, 16_384, 3_600_000_000
PREFIX, MACHINE, INSTANCE = "order", "host-001122334455", "instanceA"
DEFAULT_CONFIG = {"wal_size": 1 << 30, "cache_size": 256 << 20, "block_size": 8 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("bucket"), F.col("doc_id").alias("seq"), fr.payload_bytes(fr.payload_of("text")).alias("len"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("bucket"), "ts", F.col("event_id").alias("seq"), fr.payload_bytes(fr.payload_of("props")).alias("len"))


def placed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.object_offsets(roll_files(pack(doc_records(spark, sf_dir), B, ["seq"]), B, W))


def with_payload(placed: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), fr.payload_of("text").alias("payload")), "seq")


def manifest_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for outcomes: quality 0 is a failed log write, toxic 1 a failed block write."""
    outcome = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality", "toxic")
    rows = placed_docs(spark, sf_dir).join(outcome, "seq", "left")
    return mf.block_manifest(rows, B, F.coalesce("quality", F.lit(1)) == 1, F.coalesce("toxic", F.lit(0)) == 0)


def keyed(placed: DataFrame) -> DataFrame:
    return placed.withColumn("s3_key", fr.object_key(F.lit(PREFIX), MACHINE, INSTANCE, "bucket", "file_from_offset", "block_index"))


# Scalar functions


def framed_size(spark, sf_dir):
    n = fr.payload_bytes(fr.payload_of("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("payload_bytes"), fr.framed_size(n).alias("framed_size"))


def record_crc(spark, sf_dir):
    p = fr.payload_of("props")
    return table(spark, sf_dir, "events").select("event_id", F.crc32(p).alias("crc"), fr.record_crc(p).alias("stored_crc"), fr.crc_matches(p, fr.record_crc(p)).alias("matches"))


def record_frame(spark, sf_dir):
    frame = fr.frame(fr.payload_of("props"))
    return table(spark, sf_dir, "events").select("event_id", F.octet_length(frame).cast("long").alias("frame_bytes"), F.md5(frame).alias("frame_md5"))


def slice_payload(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fr.slice_payload(fr.payload_of("c_name"), 2, 5).cast("string").alias("part"))


def block_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fr.block_key("o_orderkey", "o_custkey").alias("block_key"))


def block_key_roundtrip(spark, sf_dir):
    key = fr.block_key("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", fr.key_file(key).alias("file_from_offset"), fr.key_index(key).alias("block_index"))


def object_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", fr.object_key(F.lit(PREFIX), MACHINE, INSTANCE, "o_orderpriority", F.col("o_orderkey") * 1024, F.pmod("o_custkey", F.lit(256)).cast("int")).alias("s3_key"))


def block_arithmetic(spark, sf_dir):
    price = F.floor("l_extendedprice").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fr.blocks_for(price, 4096).alias("blocks"), fr.whole_blocks(price, 4096).alias("whole"), fr.within_block(price, 4096).alias("within"), fr.bytes_to_mib(price * 1024).alias("mib"))


# Packing


def block_pack(spark, sf_dir):
    return pack(doc_records(spark, sf_dir), B, ["seq"]).select("bucket", "seq", "framed_size", "status", "block", "wal_pos")


def block_pack_idle(spark, sf_dir):
    return pack(event_records(spark, sf_dir), EVENT_B, ["ts", "seq"], IDLE_US).select("bucket", "seq", "framed_size", "status", "block", "wal_pos")


def block_pack_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("bucket"), F.col("page_id").alias("seq"), fr.payload_bytes(fr.payload_of("html")).alias("len"))
    return pack(p, B, ["seq"]).select("bucket", "seq", "framed_size", "status", "block", "wal_pos")


def block_pack_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("bucket"), F.col("turn").cast("long").alias("seq"), fr.payload_bytes(fr.payload_of("text")).alias("len"))
    return pack(c, 2048, ["seq"]).select("bucket", "seq", "framed_size", "status", "block", "wal_pos")


def file_roll(spark, sf_dir):
    return roll_files(pack(doc_records(spark, sf_dir), B, ["seq"]), B, W).select("bucket", "seq", "file_from_offset", "block_index", "wal_pos", "status")


def object_offsets(spark, sf_dir):
    return placed_docs(spark, sf_dir).select("bucket", "seq", "block", "object_offset", F.col("len").alias("size"))


def write_receipts(spark, sf_dir):
    return mf.write_receipts(placed_docs(spark, sf_dir), PREFIX, MACHINE, INSTANCE)


def block_concat(spark, sf_dir):
    blocks = mf.concat_blocks(with_payload(placed_docs(spark, sf_dir), spark, sf_dir))
    return blocks.select(*mf.BLOCK, F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("content_md5"))


def append_status(spark, sf_dir):
    return with_status(doc_records(spark, sf_dir), 4096).groupBy("bucket", "status").agg(F.count(F.lit(1)).alias("records"), F.sum("len").alias("bytes"))


# Manifest


def block_manifest(spark, sf_dir):
    return manifest_docs(spark, sf_dir)


def uploadable_blocks(spark, sf_dir):
    return mf.uploadable(manifest_docs(spark, sf_dir)).select(*mf.BLOCK, "finished_bytes")


def read_ready_blocks(spark, sf_dir):
    return mf.read_ready(manifest_docs(spark, sf_dir)).select(*mf.BLOCK, "page_cache_bytes")


def recover_tasks(spark, sf_dir):
    return mf.recover_tasks(manifest_docs(spark, sf_dir))


def dead_letter(spark, sf_dir):
    return mf.dead_letters(manifest_docs(spark, sf_dir), PREFIX, MACHINE, INSTANCE)


def live_blocks(spark, sf_dir):
    m = materialize(manifest_docs(spark, sf_dir), "manifest")
    return mf.live_blocks(m, mf.uploadable(m)).select(*mf.BLOCK, "state")


def event_blocks(spark, sf_dir, idle_us: int | None = None):
    rows = roll_files(pack(event_records(spark, sf_dir), EVENT_B, ["ts", "seq"], idle_us), EVENT_B, EVENT_W)
    return mf.block_manifest(rows, EVENT_B, ts="ts", idle_us=idle_us)


def idle_blocks(spark, sf_dir):
    blocks = materialize(event_blocks(spark, sf_dir), "event-blocks")
    now = blocks.agg(F.max("last_ts").alias("as_of"))
    return mf.idle_blocks(blocks.crossJoin(F.broadcast(now)), F.col("as_of"), 60_000_000).select(*mf.BLOCK, F.col("expected_bytes").alias("bytes"))  # one row beside each


def seal_idle(spark, sf_dir):
    blocks = materialize(event_blocks(spark, sf_dir, IDLE_US), "event-blocks")
    now = blocks.agg(F.max("last_ts").alias("as_of"))
    sealed = mf.seal_idle(blocks.crossJoin(F.broadcast(now)), F.col("as_of"), 60_000_000, EVENT_B)  # one row beside each
    return sealed.select(*mf.BLOCK, "records", "pad_bytes", "state", "sealed_by", "last_ts")


def seal_all(spark, sf_dir):
    return mf.seal_all(event_blocks(spark, sf_dir, IDLE_US), EVENT_B).select(*mf.BLOCK, "records", "pad_bytes", "state", "sealed_by")


def block_sealed(spark, sf_dir):
    return mf.is_sealed(manifest_docs(spark, sf_dir))


def dirty_buckets(spark, sf_dir):
    m = materialize(manifest_docs(spark, sf_dir), "manifest")
    return mf.dirty_buckets(m, mf.uploadable(mf.seal_all(m, B)))


def bucket_counters(spark, sf_dir):
    return mf.counters(manifest_docs(spark, sf_dir))


def idle_sessions(spark, sf_dir):
    return mf.idle_sessions(table(spark, sf_dir, "events"), "event_type", "ts", "1 hour")


def block_states(spark, sf_dir):
    i = F.col("p_partkey")
    state = F.when(F.col("p_size") % 8 == 1, 0).when(F.col("p_size") % 8 == 2, 1).otherwise(3)
    return table(spark, sf_dir, "part").select(F.floor(i / 16).cast("long").alias("file"), F.pmod(i, F.lit(16)).alias("idx"), state.alias("state"), (F.col("p_size") == 50).alias("failed"), F.when(F.col("p_size") == 10, 1).otherwise(0).alias("ref"))


def upload_pointer(spark, sf_dir):
    return mf.upload_pointer(block_states(spark, sf_dir), ["file"], "idx", "state", 8 << 20)


def read_pointer(spark, sf_dir):
    return mf.read_pointer(block_states(spark, sf_dir), ["file"], "idx", "state", 8 << 20)


def capped_pointer(spark, sf_dir):
    return mf.upload_pointer(block_states(spark, sf_dir), ["file"], "idx", "state", 8 << 20, F.col("failed"))


def gc_files(spark, sf_dir):
    s = block_states(spark, sf_dir)
    up, read = mf.upload_pointer(s, ["file"], "idx", "state", 8 << 20), mf.read_pointer(s, ["file"], "idx", "state", 8 << 20)
    files = s.groupBy("file").agg(F.sum("ref").alias("refs"), (F.count(F.lit(1)) == 16).alias("closed"))
    files = files.join(up.withColumnRenamed("position", "upload_position"), "file").join(read.withColumnRenamed("position", "read_position"), "file")
    return mf.collectable_files(files).select("file", "read_position", "upload_position")


def more_uploads(spark, sf_dir):
    return mf.more_uploads(block_states(spark, sf_dir), ["file"], "state", 16)


def dead_letter_ack(spark, sf_dir):
    s = block_states(spark, sf_dir)
    acks = s.where("failed").select("file", "idx")  # whoever consumed the dead letters acknowledges these blocks
    return mf.upload_pointer(mf.acknowledge(s, acks, ["file", "idx"], "state"), ["file"], "idx", "state", 8 << 20)


def recovery_candidates(spark, sf_dir):
    meta = table(spark, sf_dir, "nation").select(F.col("n_name").alias("bucket"), F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3).alias("is_dirty"), F.call_function("shiftleft", F.lit(8 << 20), F.col("n_regionkey")).alias("block_size"))
    s = table(spark, sf_dir, "supplier")
    heads = s.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("file"), (F.col("s_suppkey") % 5).alias("read_position"), (F.col("s_suppkey") % 4).alias("upload_position"))
    heads = heads.join(meta.select("k", "bucket"), "k").drop("k")
    return mf.recovery_candidates(meta, heads, F.lit(32 << 20)).select("bucket", "file", "read_position", "upload_position")


def config_resolve(spark, sf_dir):
    r = table(spark, sf_dir, "region").where(F.col("r_regionkey") % 2 == 0)
    n = table(spark, sf_dir, "nation")
    special = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("bucket"), ((F.col("n_nationkey") + 1).cast("long") * (1 << 28)).alias("wal_size"), F.lit(1 << 30).cast("long").alias("cache_size"), F.lit(16 << 20).cast("long").alias("block_size"))
    return mf.resolve_config(n.select(F.col("n_name").alias("bucket")), special, DEFAULT_CONFIG)


def state_transitions(spark, sf_dir):
    states = F.create_map(*(F.lit(x) for x in ("O", "OPEN", "F", "SEALED", "P", "UPLOADING")))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", states[F.col("o_orderstatus")].alias("state"))
    return mf.check_transitions(o, ["o_custkey"], ["o_orderkey"], "state")


def task_queue(spark, sf_dir):
    return mf.distinct_tasks(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 1024).alias("file_from_offset"), F.col("l_linenumber").alias("block_index")))


def valid_prefix(spark, sf_dir):
    rows = materialize(placed_docs(spark, sf_dir).where("status = 'PUT_OK'"), "placed")
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("seq"), F.lit(False).alias("ok"))
    return mf.valid_prefix(rows.join(bad, "seq", "left"), mf.BLOCK, "wal_pos", F.coalesce("ok", F.lit(True))).select(*mf.BLOCK, "seq", "wal_pos")


# Files and objects


def write_log(spark, sf_dir, upload_position: int = 0) -> str:
    """Writes the documents' log files; returns their root."""
    root = new_path(spark, "wal")
    wal.register(spark)
    placed = materialize(roll_files(pack(doc_records(spark, sf_dir), B, ["seq"]), B, W).where("status = 'PUT_OK'"), "wal-rows")
    last = placed.groupBy("bucket").agg(F.max("block").alias("last_block"))
    rows = with_payload(placed.join(last, "bucket"), spark, sf_dir).select("bucket", "file_from_offset", "block_index", F.col("wal_pos").cast("int").alias("wal_pos"), "payload", (F.col("block") < F.col("last_block")).alias("sealed"))
    rows = rows.repartition("bucket", "file_from_offset").sortWithinPartitions("bucket", "file_from_offset", "block_index", "wal_pos")
    rows.write.format("wal_frames").mode("append").options(instance=INSTANCE, block_bytes=B, file_bytes=W, upload_position=upload_position).save(root)
    return root


def wal_scan(spark, sf_dir):
    root = write_log(spark, sf_dir)
    found = spark.read.format("wal_frames").option("path", root).option("block_bytes", B).load()
    return found.select("bucket", "file_from_offset", "block_index", "wal_pos", "len", (F.crc32("payload") == F.col("crc").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("crc_ok"), F.md5("payload").alias("payload_md5"))


def dead_letter_consume(spark, sf_dir):
    root = write_log(spark, sf_dir)
    found = spark.read.format("wal_frames").option("path", root).option("block_bytes", B).load()
    got = mf.consume_dead_letters(dead_letter(spark, sf_dir), found)
    return got.groupBy("s3_key").agg(F.count(F.lit(1)).alias("records"), F.md5(fr.ordered_concat("wal_pos", "payload")).alias("content_md5"))


def crashed_log(spark, sf_dir) -> str:
    """A log of dirty buckets whose files are uploaded up to their first block."""
    root = write_log(spark, sf_dir, upload_position=B)
    recover.for_each(table(spark, sf_dir, "documents").select("source").distinct(), ["source"], lambda b: wal.write_bucket_meta(root, INSTANCE, b, 1, B, W, PREFIX))
    return root


def recover_commit(spark, sf_dir):
    """Positions and flags once the replayed blocks are uploaded; the second replay adds nothing."""
    root, objects = crashed_log(spark, sf_dir), new_path(spark, "objects")
    for _ in range(2):
        ob.write_objects(recover.replay(spark, root, B, MACHINE), objects)
        recover.commit(spark, root, B)
    meta = spark.read.format("bucket_meta").option("path", root).load().select("bucket", "is_dirty")
    heads = spark.read.format("wal_headers").option("path", root).load()
    return heads.join(meta, "bucket").select("bucket", "file_from_offset", "read_position", "upload_position", "is_dirty")


def gc_delete(spark, sf_dir):
    """The log files that are left once closed and uploaded ones are deleted."""
    root = crashed_log(spark, sf_dir)
    recover.commit(spark, root, B)
    recover.collect_files(spark, root)
    return spark.read.format("wal_headers").option("path", root).load().select("bucket", "file_from_offset")


def block_rescan(spark, sf_dir):
    """One block of one file of one bucket, read alone."""
    root = write_log(spark, sf_dir)
    bucket = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    found = spark.read.format("wal_frames").options(path=root, block_bytes=B, bucket=bucket, file=0, block=1).load()
    return found.select("bucket", "file_from_offset", "block_index", "wal_pos", "len", F.md5("payload").alias("payload_md5"))


def write_slices(spark, sf_dir):
    part = fr.slice_payload(fr.payload_of("text"), 2, 4000)
    records = table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), F.col("doc_id").alias("seq"), fr.payload_bytes(part).alias("len"))
    return mf.write_receipts(mf.object_offsets(roll_files(pack(records, B, ["seq"]), B, W)), PREFIX, MACHINE, INSTANCE)


def recover_replay(spark, sf_dir):
    root = crashed_log(spark, sf_dir)
    found = recover.replay(spark, root, B, MACHINE)
    return found.select("bucket", "file_from_offset", "block_index", "records", "s3_key", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("content_md5"))


def _uploaded(spark, sf_dir):
    root = new_path(spark, "objects")
    placed = materialize(placed_docs(spark, sf_dir), "placed")
    blocks = keyed(mf.concat_blocks(with_payload(placed, spark, sf_dir)))
    ob.write_objects(blocks, root)
    return root, placed


def verify_uploads(spark, sf_dir):
    root, placed = _uploaded(spark, sf_dir)
    expected = keyed(placed.where("status = 'PUT_OK'").groupBy(*mf.BLOCK).agg(F.sum("len").alias("bytes")))
    return ob.verify_uploads(expected, root)


def point_lookup(spark, sf_dir):
    root, placed = _uploaded(spark, sf_dir)
    got = ob.read_ranges(mf.write_receipts(placed, PREFIX, MACHINE, INSTANCE), root)
    return got.select("bucket", "seq", F.md5("payload").alias("payload_md5"))


def block_pack_stream(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    records = events.select(F.col("event_type").alias("bucket"), F.col("event_id").alias("seq"), "ts", fr.payload_bytes(fr.payload_of("props")).alias("len"))
    stream = st.pack_stream(with_status(records, EVENT_B), EVENT_B, IDLE_US)
    out = st.run_available(spark, stream, new_path(spark, "stream-out"), new_path(spark, "stream-checkpoint"))
    return out.select("bucket", "seq", "framed_size", "status", "block", "wal_pos")


def stream_upload(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    payload = fr.payload_of("props")
    records = with_status(events.select(F.col("event_type").alias("bucket"), F.col("event_id").alias("seq"), "ts", fr.payload_bytes(payload).alias("len"), payload.alias("payload")), EVENT_B)
    uploader = up.Uploader(spark, new_path(spark, "stream-upload"), EVENT_B, EVENT_W, PREFIX, MACHINE, INSTANCE, IDLE_US)
    return up.ingest(records, uploader, new_path(spark, "stream-checkpoint"))


ALL = (framed_size, record_crc, record_frame, slice_payload, block_key, block_key_roundtrip, object_key, block_arithmetic, block_pack, block_pack_idle, block_pack_pages, block_pack_turns, file_roll, object_offsets, write_receipts, block_concat, append_status, block_manifest, uploadable_blocks, read_ready_blocks, recover_tasks, dead_letter, live_blocks, idle_blocks, idle_sessions, upload_pointer, read_pointer, capped_pointer, gc_files, recovery_candidates, config_resolve, state_transitions, task_queue, valid_prefix, wal_scan, recover_replay, verify_uploads, point_lookup, block_pack_stream, seal_idle, seal_all, block_sealed, dirty_buckets, bucket_counters, more_uploads, dead_letter_ack, dead_letter_consume, recover_commit, gc_delete, block_rescan, write_slices, stream_upload)
QUERIES = {f.__name__: f for f in ALL}


# SQL


def _pack_sql(source: str, block: int, order: str = "seq", idle_us: int | None = None) -> str:
    """CTEs: judged (all records) and packed (those with a place). ``source`` gives bucket, seq, ts, text."""
    gap = f" OR epoch_us(r.ts) - epoch_us(p.ts) > {idle_us}" if idle_us else ""
    opens = f"(p.wal_pos + p.framed_size + r.framed_size > {block}{gap})"
    return f"""
WITH RECURSIVE judged AS (
  SELECT *, (12 + len + 3) & -4 AS framed_size,
         CASE WHEN len > 0 AND (12 + len + 3) & -4 <= {block} THEN 'PUT_OK' ELSE 'INVALID_ARGUMENT' END AS status
  FROM (SELECT *, octet_length(encode(text))::BIGINT AS len FROM ({source}))),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {order}) AS rn FROM judged WHERE status = 'PUT_OK'),
packed AS (
  SELECT bucket, seq, ts, text, len, framed_size, rn, 0::BIGINT AS block, 0::BIGINT AS wal_pos FROM r WHERE rn = 1
  UNION ALL
  SELECT r.bucket, r.seq, r.ts, r.text, r.len, r.framed_size, r.rn,
         CASE WHEN {opens} THEN p.block + 1 ELSE p.block END,
         CASE WHEN {opens} THEN 0 ELSE p.wal_pos + p.framed_size END
  FROM packed p JOIN r ON r.bucket = p.bucket AND r.rn = p.rn + 1)"""


_DOCS = "SELECT source AS bucket, doc_id AS seq, NULL::TIMESTAMP AS ts, text FROM documents"
_EVENTS = "SELECT event_type AS bucket, event_id AS seq, ts, props AS text FROM events"
_PLACE = "bucket, seq, framed_size, status, block, wal_pos FROM judged LEFT JOIN (SELECT bucket, seq, block, wal_pos FROM packed) USING (bucket, seq)"
_BLOCK = "bucket, (block // 4) * 262144 AS file_from_offset, (block % 4)::INT AS block_index"
_DOC_PACK = _pack_sql(_DOCS, B)
_SLICES = _pack_sql("SELECT bucket, seq, ts, repeat('x', greatest(0, least(4000, octet_length(encode(text)) - 2))::INT) AS text FROM (" + _DOCS + ")", B)


def _offsets(packed: str) -> str:
    return f"""{packed},
placed AS (
  SELECT {_BLOCK}, seq, text, len, framed_size, block, wal_pos,
         coalesce(sum(len) OVER (PARTITION BY bucket, block ORDER BY wal_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS object_offset
  FROM packed)"""


_OFFSETS = _offsets(_DOC_PACK)
_POSITIONS = f"""{_OFFSETS}, p AS (
  SELECT bucket, file_from_offset, max(tail)::BIGINT AS read_position, max(max(file_from_offset)) OVER (PARTITION BY bucket) AS last
  FROM (SELECT bucket, file_from_offset, CASE WHEN block < max(block) OVER (PARTITION BY bucket) THEN (block_index + 1) * {B} ELSE block_index * {B} + sum(framed_size) END AS tail
        FROM placed GROUP BY bucket, file_from_offset, block_index, block)
  GROUP BY bucket, file_from_offset)"""
_EVENT_PLACE = "bucket, (block // 4) * 16384 AS file_from_offset, (block % 4)::INT AS block_index"


def _event_blocks(idle_us: int | None) -> str:
    """CTE b: a row a block of the events, whether and by what it is sealed."""
    cause = f"CASE WHEN NOT sealed THEN 'NONE' WHEN epoch_us(next_ts) - epoch_us(last_ts) > {idle_us} THEN 'IDLE' ELSE 'SIZE' END" if idle_us else "CASE WHEN sealed THEN 'SIZE' ELSE 'NONE' END"
    return f"""{_pack_sql(_EVENTS, EVENT_B, "ts, seq", idle_us)},
e AS (SELECT bucket, block, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts, sum(len)::BIGINT AS bytes, sum(framed_size)::BIGINT AS framed_bytes FROM packed GROUP BY ALL),
n AS (SELECT *, lead(first_ts) OVER (PARTITION BY bucket ORDER BY block) AS next_ts, lead(first_ts) OVER (PARTITION BY bucket ORDER BY block) IS NOT NULL AS sealed, max(last_ts) OVER () AS as_of FROM e),
b AS (SELECT *, {cause} AS cause FROM n)"""


def _key_sql(bucket: str, file: str, index: str) -> str:
    name = f"concat_ws('_', '{MACHINE}', '{INSTANCE}', {bucket}, ({file})::VARCHAR, ({index})::VARCHAR)"
    return f"""'{PREFIX}/' || list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({name}) + 1), lambda i: ascii(substr({name}, i::INT, 1))::BIGINT)), lambda h, c: (h * 31 + c) & 16777215) || '_' || {name} || '.block'"""


_KEY = _key_sql("bucket", "file_from_offset", "block_index")
_MANIFEST = f"""{_OFFSETS},
outcome AS (
  SELECT p.*, coalesce(l.quality, 1) = 1 AS wal_ok, coalesce(l.quality, 1) = 1 AND coalesce(l.toxic, 0) = 0 AS done
  FROM placed p LEFT JOIN labels l ON l.doc_id = p.seq),
m AS (
  SELECT bucket, file_from_offset, block_index, block, count(*) AS records, sum(len)::BIGINT AS expected_bytes,
         coalesce(sum(len) FILTER (WHERE wal_ok), 0)::BIGINT AS page_cache_bytes,
         coalesce(sum(len) FILTER (WHERE done), 0)::BIGINT AS finished_bytes, sum(framed_size)::BIGINT AS framed_bytes,
         min(seq) AS first_seq, max(seq) AS last_seq, bool_or(NOT done) AS is_broken
  FROM outcome GROUP BY ALL),
manifest AS (
  SELECT bucket, file_from_offset, block_index, records, expected_bytes, page_cache_bytes, finished_bytes, framed_bytes, first_seq, last_seq,
         NULL::TIMESTAMP AS last_ts, is_broken, CASE WHEN sealed THEN {B} - framed_bytes ELSE 0 END AS pad_bytes,
         CASE WHEN sealed THEN 'SEALED' ELSE 'OPEN' END AS state, CASE WHEN sealed THEN 'SIZE' ELSE 'NONE' END AS sealed_by
  FROM (SELECT *, block < max(block) OVER (PARTITION BY bucket) AS sealed FROM m))"""
_STATES = """
WITH s AS (SELECT p_partkey // 16 AS file, p_partkey % 16 AS idx, p_size = 50 AS failed,
                  CASE p_size % 8 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS state, (p_size = 10)::INT AS ref FROM part)"""
_CRC = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
h AS (SELECT event_id, props, hex(encode(props)) AS h FROM events),
c AS (SELECT event_id, props, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, (k * 2 + 1)::INT, 2))::BIGINT)),
             lambda a, b: xor(a >> 8, tab[((xor(a, b)) & 255) + 1])), 4294967295) AS crc FROM h, t)"""

ORACLE_SQL = {
    "framed_size": "SELECT doc_id, octet_length(encode(text))::BIGINT AS payload_bytes, (12 + octet_length(encode(text)) + 3)::BIGINT & -4 AS framed_size FROM documents",
    "record_crc": f"{_CRC} SELECT event_id, crc, (CASE WHEN crc >= 2147483648 THEN crc - 4294967296 ELSE crc END)::INT AS stored_crc, true AS matches FROM c",
    "record_frame": f"""{_CRC}, w AS (SELECT *, octet_length(encode(props)) AS n, printf('%08x', crc) AS c8, printf('%08x', octet_length(encode(props))) AS n8 FROM c)
SELECT event_id, ((n + 15) & -4)::BIGINT AS frame_bytes,
       md5(unhex('43433353' || substr(c8, 7, 2) || substr(c8, 5, 2) || substr(c8, 3, 2) || substr(c8, 1, 2) || substr(n8, 7, 2) || substr(n8, 5, 2) || substr(n8, 3, 2) || substr(n8, 1, 2))
           || encode(props) || unhex(repeat('00', (((n + 15) & -4) - n - 12)::INT))) AS frame_md5 FROM w""",
    "slice_payload": "SELECT c_custkey, substr(c_name, 3, 5) AS part FROM customer",
    "block_key": "SELECT o_orderkey, (o_orderkey << 8) | (o_custkey & 255) AS block_key FROM orders",
    "block_key_roundtrip": "SELECT o_orderkey, o_orderkey AS file_from_offset, (o_custkey & 255)::INT AS block_index FROM orders",
    "object_key": f"SELECT o_orderkey, {_key_sql('o_orderpriority', 'o_orderkey * 1024', 'o_custkey % 256')} AS s3_key FROM orders",
    "block_arithmetic": "SELECT l_orderkey, l_linenumber, (p + 4095) // 4096 AS blocks, p // 4096 AS whole, p % 4096 AS within, (p * 1024) // 1048576 AS mib FROM (SELECT *, floor(l_extendedprice)::BIGINT AS p FROM lineitem)",
    "block_pack": f"{_DOC_PACK} SELECT {_PLACE}",
    "block_pack_idle": f"{_pack_sql(_EVENTS, EVENT_B, 'ts, seq', IDLE_US)} SELECT {_PLACE}",
    "block_pack_stream": f"{_pack_sql(_EVENTS, EVENT_B, 'ts, seq', IDLE_US)} SELECT {_PLACE}",
    "block_pack_pages": _pack_sql("SELECT 'pages' AS bucket, page_id AS seq, NULL::TIMESTAMP AS ts, html AS text FROM pages", B) + f" SELECT {_PLACE}",
    "block_pack_turns": _pack_sql("SELECT conv_id::VARCHAR AS bucket, turn::BIGINT AS seq, NULL::TIMESTAMP AS ts, text FROM conversations", 2048) + f" SELECT {_PLACE}",
    "file_roll": f"{_DOC_PACK} SELECT bucket, seq, (block // 4) * 262144 AS file_from_offset, (block % 4)::INT AS block_index, wal_pos, status FROM judged LEFT JOIN (SELECT bucket, seq, block, wal_pos FROM packed) USING (bucket, seq)",
    "object_offsets": f"{_OFFSETS} SELECT j.bucket, j.seq, p.block, p.object_offset, j.len AS size FROM judged j LEFT JOIN placed p ON p.bucket = j.bucket AND p.seq = j.seq",
    "write_receipts": f"{_OFFSETS}, k AS (SELECT *, {_KEY} AS s3_key FROM placed) SELECT j.bucket, j.seq, k.s3_key, coalesce(k.object_offset, -1) AS object_offset, coalesce(k.len, -1) AS size, j.status = 'PUT_OK' AS is_success, j.status FROM judged j LEFT JOIN k ON k.bucket = j.bucket AND k.seq = j.seq",
    "write_slices": f"{_offsets(_SLICES)}, k AS (SELECT *, {_KEY} AS s3_key FROM placed) SELECT j.bucket, j.seq, k.s3_key, coalesce(k.object_offset, -1) AS object_offset, coalesce(k.len, -1) AS size, j.status = 'PUT_OK' AS is_success, j.status FROM judged j LEFT JOIN k ON k.bucket = j.bucket AND k.seq = j.seq",
    "block_concat": f"{_OFFSETS} SELECT bucket, file_from_offset, block_index, sum(len)::BIGINT AS bytes, md5(string_agg(text, '' ORDER BY wal_pos)) AS content_md5 FROM placed GROUP BY ALL",
    "append_status": "SELECT bucket, status, count(*) AS records, sum(len)::BIGINT AS bytes FROM (SELECT source AS bucket, octet_length(encode(text))::BIGINT AS len, CASE WHEN octet_length(encode(text)) > 0 AND (octet_length(encode(text)) + 15) & -4 <= 4096 THEN 'PUT_OK' ELSE 'INVALID_ARGUMENT' END AS status FROM documents) GROUP BY ALL",
    "block_manifest": f"{_MANIFEST} SELECT * FROM manifest",
    "uploadable_blocks": f"{_MANIFEST} SELECT bucket, file_from_offset, block_index, finished_bytes FROM manifest WHERE state = 'SEALED' AND page_cache_bytes = finished_bytes",
    "read_ready_blocks": f"{_MANIFEST} SELECT bucket, file_from_offset, block_index, page_cache_bytes FROM manifest WHERE state = 'SEALED' AND expected_bytes = page_cache_bytes",
    "recover_tasks": f"{_MANIFEST} SELECT bucket, file_from_offset, block_index FROM manifest WHERE state = 'SEALED' AND is_broken",
    "dead_letter": f"{_MANIFEST} SELECT '{INSTANCE}' AS instance, bucket, file_from_offset, block_index, {_KEY} AS s3_key FROM manifest WHERE state = 'SEALED' AND page_cache_bytes <> finished_bytes",
    "live_blocks": f"{_MANIFEST} SELECT bucket, file_from_offset, block_index, state FROM manifest WHERE NOT (state = 'SEALED' AND page_cache_bytes = finished_bytes)",
    "idle_blocks": f"{_event_blocks(None)} SELECT {_EVENT_PLACE}, bytes FROM b WHERE NOT sealed AND epoch_us(as_of) - epoch_us(last_ts) > 60000000",
    "seal_idle": f"""{_event_blocks(IDLE_US)}, t AS (SELECT *, NOT sealed AND epoch_us(as_of) - epoch_us(last_ts) > 60000000 AS now FROM b)
SELECT {_EVENT_PLACE}, records, CASE WHEN sealed OR now THEN {EVENT_B} - framed_bytes ELSE 0 END AS pad_bytes, CASE WHEN sealed OR now THEN 'SEALED' ELSE 'OPEN' END AS state,
       CASE WHEN now THEN 'IDLE' ELSE cause END AS sealed_by, last_ts FROM t""",
    "seal_all": f"{_event_blocks(IDLE_US)} SELECT {_EVENT_PLACE}, records, {EVENT_B} - framed_bytes AS pad_bytes, 'SEALED' AS state, CASE WHEN sealed THEN cause ELSE 'CLOSE' END AS sealed_by FROM b",
    "stream_upload": f"{_event_blocks(IDLE_US)}, k AS (SELECT {_EVENT_PLACE}, bytes, CASE WHEN sealed THEN cause ELSE 'CLOSE' END AS sealed_by FROM b) SELECT bucket, file_from_offset, block_index, {_KEY} AS s3_key, bytes, sealed_by, true AS verified FROM k",
    "block_sealed": f"{_MANIFEST} SELECT bucket, file_from_offset, block_index, (file_from_offset << 8) | block_index AS block_key, state = 'SEALED' AS is_sealed FROM manifest",
    "dirty_buckets": f"{_MANIFEST} SELECT bucket, bool_or(page_cache_bytes <> finished_bytes) AS is_dirty FROM manifest GROUP BY bucket",
    "bucket_counters": f"""{_MANIFEST} SELECT bucket, count(*) FILTER (WHERE state = 'OPEN') AS open, count(*) FILTER (WHERE state = 'SEALED') AS sealed,
  count(*) FILTER (WHERE state = 'SEALED' AND page_cache_bytes = finished_bytes) AS queued, count(*) FILTER (WHERE state = 'SEALED' AND page_cache_bytes <> finished_bytes) AS dead,
  count(*) FILTER (WHERE is_broken) AS broken, sum(expected_bytes)::BIGINT AS bytes FROM manifest GROUP BY bucket""",
    "more_uploads": f"{_STATES} SELECT file, count(*) FILTER (WHERE state = 3) AS acked_blocks, count(*) FILTER (WHERE state = 3) < 16 AS more FROM s GROUP BY file",
    "dead_letter_ack": f"{_STATES} SELECT file, (coalesce(min(idx) FILTER (WHERE state <> 3 AND NOT failed), count(*)) * 8388608)::BIGINT AS position FROM s GROUP BY file",
    "dead_letter_consume": f"{_MANIFEST}, d AS (SELECT *, {_KEY} AS s3_key FROM manifest WHERE state = 'SEALED' AND page_cache_bytes <> finished_bytes) SELECT s3_key, count(*) AS records, md5(string_agg(text, '' ORDER BY wal_pos)) AS content_md5 FROM d JOIN placed USING (bucket, file_from_offset, block_index) GROUP BY s3_key",
    "recover_commit": f"{_POSITIONS} SELECT bucket, file_from_offset, read_position, greatest(read_position, {B}) AS upload_position, 0 AS is_dirty FROM p",
    "gc_delete": f"{_POSITIONS} SELECT bucket, file_from_offset FROM p WHERE read_position < {B} OR file_from_offset = last",
    "block_rescan": f"{_OFFSETS} SELECT bucket, file_from_offset, block_index, wal_pos::INT AS wal_pos, len::INT AS len, md5(text) AS payload_md5 FROM placed WHERE bucket = (SELECT min(source) FROM documents) AND file_from_offset = 0 AND block_index = 1",
    "idle_sessions": "SELECT event_type AS bucket, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session FROM (SELECT *, (coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 0) > 3600000000)::INT AS new FROM events)) GROUP BY event_type, session",
    "upload_pointer": f"{_STATES} SELECT file, (coalesce(min(idx) FILTER (WHERE state <> 3), count(*)) * 8388608)::BIGINT AS position FROM s GROUP BY file",
    "read_pointer": f"{_STATES} SELECT file, (coalesce(min(idx) FILTER (WHERE state = 0), count(*)) * 8388608)::BIGINT AS position FROM s GROUP BY file",
    "capped_pointer": f"{_STATES} SELECT file, (coalesce(min(idx) FILTER (WHERE state <> 3 OR failed), count(*)) * 8388608)::BIGINT AS position FROM s GROUP BY file",
    "gc_files": f"{_STATES}, p AS (SELECT file, sum(ref) AS refs, count(*) AS n, (coalesce(min(idx) FILTER (WHERE state = 0), count(*)) * 8388608)::BIGINT AS read_position, (coalesce(min(idx) FILTER (WHERE state <> 3), count(*)) * 8388608)::BIGINT AS upload_position FROM s GROUP BY file) SELECT file, read_position, upload_position FROM p WHERE refs = 0 AND n = 16 AND read_position = upload_position",
    "recovery_candidates": "SELECT n_name AS bucket, s_suppkey AS file, s_suppkey % 5 AS read_position, s_suppkey % 4 AS upload_position FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey % 3 <> 0 AND 33554432 >= (8388608::BIGINT << n_regionkey) AND s_suppkey % 5 <> s_suppkey % 4",
    "config_resolve": f"SELECT n_name AS bucket, CASE WHEN n_regionkey % 2 = 0 THEN (n_nationkey + 1)::BIGINT * 268435456 ELSE {DEFAULT_CONFIG['wal_size']} END AS wal_size, CASE WHEN n_regionkey % 2 = 0 THEN 1073741824 ELSE {DEFAULT_CONFIG['cache_size']} END::BIGINT AS cache_size, CASE WHEN n_regionkey % 2 = 0 THEN 16777216 ELSE {DEFAULT_CONFIG['block_size']} END::BIGINT AS block_size FROM nation",
    "state_transitions": "SELECT o_custkey, o_orderkey, from_state, to_state, (from_state, to_state) IN (('OPEN', 'SEALED'), ('SEALED', 'UPLOADING')) AS allowed FROM (SELECT o_custkey, o_orderkey, state AS to_state, lag(state) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS from_state FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'SEALED' WHEN 'P' THEN 'UPLOADING' END AS state FROM orders)) WHERE from_state IS NOT NULL",
    "task_queue": "SELECT DISTINCT l_suppkey * 1024 AS file_from_offset, l_linenumber AS block_index, ((l_suppkey * 1024) << 8) | (l_linenumber & 255) AS block_key FROM lineitem",
    "valid_prefix": f"{_OFFSETS}, v AS (SELECT p.*, min(wal_pos) FILTER (WHERE l.toxic = 1) OVER (PARTITION BY p.bucket, p.block) AS bad FROM placed p LEFT JOIN labels l ON l.doc_id = p.seq) SELECT bucket, file_from_offset, block_index, seq, wal_pos FROM v WHERE bad IS NULL OR wal_pos < bad",
    "wal_scan": f"{_OFFSETS} SELECT bucket, file_from_offset, block_index, wal_pos::INT AS wal_pos, len::INT AS len, true AS crc_ok, md5(text) AS payload_md5 FROM placed",
    "recover_replay": f"{_OFFSETS} SELECT bucket, file_from_offset, block_index, count(*) AS records, {_KEY} AS s3_key, sum(len)::BIGINT AS bytes, md5(string_agg(text, '' ORDER BY wal_pos)) AS content_md5 FROM placed WHERE block_index > 0 GROUP BY ALL",
    "verify_uploads": f"{_OFFSETS} SELECT {_KEY} AS s3_key, sum(len)::BIGINT AS bytes, sum(len)::BIGINT AS stored_bytes, true AS verified FROM placed GROUP BY ALL",
    "point_lookup": f"{_OFFSETS} SELECT bucket, seq, md5(text) AS payload_md5 FROM placed",
}
