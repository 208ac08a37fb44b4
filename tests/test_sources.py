"""Log files, bucket metadata and objects: round trips, damage, recovery."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.frames import FILE_HEADER_BYTES
from quarry.operators.pack import pack, roll_files
from quarry.plans import recover
from quarry.sources import objects as ob
from quarry.sources import wal

BLOCK, FILE = 64, 128


@pytest.fixture()
def log(spark, tmp_path):
    wal.register(spark)
    rows = [("b", seq, bytes([65 + seq]) * n) for seq, n in enumerate([20, 20, 20, 52, 1, 4, 40])] + [("c", 0, b"CC3S" * 3)]
    df = spark.createDataFrame(rows, "bucket string, seq long, payload binary").withColumn("len", F.octet_length("payload").cast("long"))
    placed = roll_files(pack(df.drop("payload"), BLOCK, ["seq"]), BLOCK, FILE).join(df.select("bucket", "seq", "payload"), ["bucket", "seq"])
    last = placed.groupBy("bucket").agg(F.max("block").alias("m"))
    out = placed.join(last, "bucket").select("bucket", "file_from_offset", "block_index", F.col("wal_pos").cast("int").alias("wal_pos"), "payload", (F.col("block") < F.col("m")).alias("sealed"))
    out = out.repartition(2, "bucket", "file_from_offset").sortWithinPartitions("bucket", "file_from_offset", "block_index", "wal_pos")
    out.write.format("wal_frames").mode("append").options(instance="i", block_bytes=BLOCK, file_bytes=FILE).save(str(tmp_path))
    return str(tmp_path), rows


def scan(spark, root, **options):
    return spark.read.format("wal_frames").options(path=root, block_bytes=BLOCK, **options).load()


def test_round_trip(spark, log):
    root, rows = log
    got = sorted(scan(spark, root).collect(), key=lambda r: (r.bucket, r.file_from_offset, r.block_index, r.wal_pos))
    assert [bytes(r.payload) for r in got] == [p for _, _, p in rows]
    assert all(r.valid for r in got)


def test_damage_drops_the_rest_of_its_block_only(spark, log):
    root, rows = log
    path = f"{root}/i/b/wal/0"
    data = bytearray(open(path, "rb").read())
    data[FILE_HEADER_BYTES + 32 + 12] ^= 1  # second frame of block 0
    open(path, "wb").write(data)
    assert scan(spark, root).count() == len(rows) - 1
    assert scan(spark, root, mode="PERMISSIVE").where("not valid").count() == 1
    with pytest.raises(Exception, match="invalid frame"):
        scan(spark, root, mode="FAILFAST").collect()


def test_bucket_meta(spark, tmp_path):
    wal.register(spark)
    wal.write_bucket_meta(str(tmp_path), "i", "good", 1, BLOCK, FILE, "pré/fix")
    wal.write_bucket_meta(str(tmp_path), "i", "bad", 0, BLOCK, FILE, "p")
    bad = tmp_path / "i/bad/bucketMeta"
    data = bytearray(bad.read_bytes())
    data[4] ^= 1
    bad.write_bytes(data)
    got = spark.read.format("bucket_meta").option("path", str(tmp_path)).load().collect()
    assert [(r.bucket, r.is_dirty, r.block_size, r.file_size, r.prefix) for r in got] == [("good", 1, BLOCK, FILE, "pré/fix")]


def test_replay_gives_the_same_objects(spark, log):
    root, rows = log
    for b in ("b", "c"):
        wal.write_bucket_meta(root, "i", b, 1, BLOCK, FILE, "old")
    got = recover.replay(spark, root, BLOCK, "m").collect()
    assert b"".join(bytes(r.content) for r in sorted(got, key=lambda r: (r.bucket, r.file_from_offset, r.block_index))) == b"".join(p for _, _, p in rows)
    assert all(r.s3_key.startswith("old/") for r in got)
    wal.write_bucket_meta(root, "i", "c", 0, BLOCK, FILE, "old")
    assert {r.bucket for r in recover.replay(spark, root, BLOCK, "m").collect()} == {"b"}  # c is clean
    assert recover.replay(spark, root, BLOCK // 2, "m").count() == 0  # blocks were larger


def test_objects(spark, tmp_path):
    df = spark.createDataFrame([("p/a.block", bytearray(b"xyz")), ("p/b.block", bytearray(b"q"))], "s3_key string, content binary")
    ob.write_objects(df, str(tmp_path))
    ob.write_objects(df, str(tmp_path))  # idempotent
    assert {(r.s3_key, bytes(r.content)) for r in ob.read_objects(spark, str(tmp_path)).collect()} == {("p/a.block", b"xyz"), ("p/b.block", b"q")}
    want = spark.createDataFrame([("p/a.block", 3), ("p/b.block", 2), ("p/none.block", 1)], "s3_key string, bytes long")
    assert {r.s3_key: r.verified for r in ob.verify_uploads(want, str(tmp_path)).collect()} == {"p/a.block": True, "p/b.block": False, "p/none.block": False}
    for bad in (("", "k", b""), (str(tmp_path), " / ".strip(), b""), (str(tmp_path), "k", None)):
        with pytest.raises(ValueError):
            ob.put_object(*bad)


def test_one_block_again(spark, log):
    root, rows = log
    got = scan(spark, root, bucket="b", file=0, block=1).collect()
    assert {(r.bucket, r.file_from_offset, r.block_index) for r in got} == {("b", 0, 1)}
    assert scan(spark, root, bucket="none").count() == 0
    assert scan(spark, root, bucket="b", file=0, block=9).count() == 0


def test_commit_moves_positions_and_clears_flags(spark, log):
    root, _ = log
    for b in ("b", "c"):
        wal.write_bucket_meta(root, "i", b, 1, BLOCK, FILE, "old")
    heads = lambda: {(r.bucket, r.file_from_offset): (r.read_position, r.upload_position) for r in spark.read.format("wal_headers").option("path", root).load().collect()}
    before, frames = heads(), scan(spark, root).count()
    recover.commit(spark, root, BLOCK)
    assert heads() == {k: (read, read) for k, (read, _) in before.items()}
    assert recover.replay(spark, root, BLOCK, "m").count() == 0
    assert all(r.is_dirty == 0 and r.prefix == "old" for r in spark.read.format("bucket_meta").option("path", root).load().collect())
    assert scan(spark, root).count() == frames  # nothing but the header has changed
    assert wal.move_positions(root, "i", "b", 0, read=1, upload=1) == (before["b", 0][0],) * 2  # never back
    recover.commit(spark, root, BLOCK)
    in_use = spark.createDataFrame([("b", 0, 1)], "bucket string, file_from_offset long, refs int")
    files = {k for k in before if k[0] == "b"}
    assert recover.collect_files(spark, root, in_use) == len(files) - 2
    assert set(heads()) == {("b", 0), max(files), ("c", 0)}
    assert recover.collect_files(spark, root) == 1 and recover.collect_files(spark, root) == 0


def test_ranges(spark, tmp_path):
    ob.put_object(str(tmp_path), "p/a.block", b"0123456789")
    rows = [("x", 1, "p/a.block", 2, 3, True), ("x", 2, "p/a.block", 8, 5, True), ("x", 3, "p/none.block", 0, 1, True), ("x", 4, None, -1, -1, False), ("x", 5, "p/a.block", 0, 10, True)]
    df = spark.createDataFrame(rows, "bucket string, seq long, s3_key string, object_offset long, size int, is_success boolean")
    got = {r.seq: r.payload and bytes(r.payload) for r in ob.read_ranges(df, str(tmp_path)).collect()}
    assert got == {1: b"234", 2: None, 3: None, 5: b"0123456789"}


def test_a_put_is_tried_again_and_leaves_nothing_behind(tmp_path, monkeypatch):
    from pyarrow import fs as pafs

    fails, real = [OSError(), OSError()], ob.open_root

    class Flaky:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, a, b):
            if fails:
                raise fails.pop()
            self.fs.move(a, b)

    monkeypatch.setattr(ob, "open_root", lambda root: (Flaky(real(root)[0]), real(root)[1]))
    ob.put_object(str(tmp_path), "p/a.block", b"xyz")
    assert [f.path.split("/")[-1] for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path / "p")))] == ["a.block"]
    fails += [OSError()] * ob.ATTEMPTS
    with pytest.raises(OSError):
        ob.put_object(str(tmp_path), "p/b.block", b"xyz")
    assert len(list((tmp_path / "p").iterdir())) == 1


def test_store_options():
    got = ob.store_options("a", "b", "http://store:9000", path_style=False)
    assert got["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000" and got["spark.hadoop.fs.s3a.path.style.access"] == "false"
    with pytest.raises(ValueError):
        ob.store_options("a", " ", "http://store:9000")


def test_small_files_share_tasks(tmp_path):
    """Tasks grow with the bytes of a log, not with its files: 300 files are read whole by two."""
    from collections import namedtuple

    row = namedtuple("row", "bucket file_from_offset block_index wal_pos payload sealed")
    writer = wal.FramesWriter({"path": str(tmp_path), "instance": "i", "block_bytes": BLOCK, "file_bytes": FILE})
    writer.commit([writer.write(row("b", k * FILE, k % 2, 0, b"%d" % k, False) for k in range(300)), None])
    frames, heads = wal.FramesReader({"path": str(tmp_path), "block_bytes": BLOCK}), wal.HeadersReader({"path": str(tmp_path)})
    assert len(frames.partitions()) == 2 and len(heads.partitions()) == 2
    got = [r for p in frames.partitions() for b in frames.read(p) for r in b.to_pylist()]
    assert [(r["file_from_offset"], r["block_index"], r["payload"]) for r in got] == [(k * FILE, k % 2, b"%d" % k) for k in range(300)]
    assert [r[2:5] for p in heads.partitions() for r in heads.read(p)] == [(k * FILE, k % 2 * BLOCK + 16, 0) for k in range(300)]
    frames.GROUP = 0
    assert len(frames.partitions()) == 300
    empty = wal.FramesReader({"path": f"{tmp_path}/none", "block_bytes": BLOCK})
    assert [b for p in empty.partitions() for b in empty.read(p)] == []


def test_a_batch_ends_where_it_is_full(tmp_path):
    from collections import namedtuple

    row = namedtuple("row", "bucket file_from_offset block_index wal_pos payload sealed")
    writer = wal.FramesWriter({"path": str(tmp_path), "instance": "i", "block_bytes": BLOCK, "file_bytes": FILE})
    writer.commit([writer.write(row("b", 0, k // 2, k % 2 * 32, bytes(20), True) for k in range(4))])
    frames = wal.FramesReader({"path": str(tmp_path), "block_bytes": BLOCK})
    frames.BATCH = BLOCK
    assert [b.num_rows for p in frames.partitions() for b in frames.read(p)] == [2, 2]


def test_many_files_are_collected_by_few_tasks(spark, tmp_path):
    from collections import namedtuple

    row = namedtuple("row", "bucket file_from_offset block_index wal_pos payload sealed")
    writer = wal.FramesWriter({"path": str(tmp_path), "instance": "i", "block_bytes": BLOCK, "file_bytes": FILE, "upload_position": 16})
    writer.commit([writer.write(row("b", k * FILE, k % 2, 0, b"%d" % k, False) for k in range(300))])  # even ones are uploaded
    wal.register(spark)
    heads = spark.read.format("wal_headers").option("path", str(tmp_path)).load()
    assert heads.rdd.getNumPartitions() == 2
    assert recover.collect_files(spark, str(tmp_path)) == 150
    left = spark.read.format("wal_headers").option("path", str(tmp_path)).load()
    assert sorted(r.file_from_offset for r in left.collect()) == [k * FILE for k in range(1, 300, 2)]
