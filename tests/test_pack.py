"""Next-fit packing against a plain fold, for any cut into chunks."""

import datetime as dt
import random

import pytest

from quarry.operators import manifest as mf
from quarry.operators.pack import pack, roll_files


def fold(rows, block, idle_us=None):
    """(bucket, order..., len) rows -> {(bucket, seq): (block, pos)}."""
    state, out = {}, {}
    for r in sorted(rows):
        bucket, seq, n, ts = r[0], r[-2], r[-1], r[1] if idle_us is not None else None
        framed = (12 + n + 3) & ~3 if n is not None else None
        if n is None or n <= 0 or framed > block:
            out[bucket, seq] = (None, None)
            continue
        g, used, last = state.get(bucket, (0, 0, None))
        if used + framed > block or (idle_us is not None and last is not None and (ts - last) // dt.timedelta(microseconds=1) > idle_us):
            g, used = g + 1, 0
        out[bucket, seq] = (g, used)
        state[bucket] = (g, used + framed, ts)
    return out


def test_golden_layout(spark):
    rows = [("b", seq, n) for seq, n in enumerate([20, 20, 20, 52, 1, 100, 4, 40], 1)]
    packed = roll_files(pack(spark.createDataFrame(rows, "bucket string, seq long, len long"), 64, ["seq"]), 64, 128)
    got = {r.seq: (r.block, r.file_from_offset, r.block_index, r.wal_pos, r.object_offset, r.status) for r in mf.object_offsets(packed).collect()}
    assert got[1] == (0, 0, 0, 0, 0, "PUT_OK")
    assert got[2] == (0, 0, 0, 32, 20, "PUT_OK")  # an exact fit stays
    assert got[3] == (1, 0, 1, 0, 0, "PUT_OK")
    assert got[4] == (2, 128, 0, 0, 0, "PUT_OK")
    assert got[5] == (3, 128, 1, 0, 0, "PUT_OK")
    assert got[6] == (None, None, None, None, None, "INVALID_ARGUMENT")
    assert got[7] == (3, 128, 1, 16, 1, "PUT_OK")
    assert got[8] == (4, 256, 0, 0, 0, "PUT_OK")


@pytest.mark.parametrize("chunk_rows", [3, 17, 1000])
def test_chunks_do_not_matter(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b"]), seq, rng.choice([None, 0, 1, 5, 20, 30, 40, 52, 53, 90])) for seq in range(300)]
    got = pack(spark.createDataFrame(rows, "bucket string, seq long, len long"), 64, ["seq"], chunk_rows=chunk_rows)
    assert {(r.bucket, r.seq): (r.block, r.wal_pos) for r in got.collect()} == fold(rows, 64)


@pytest.mark.parametrize("chunk_rows", [4, 1000])
def test_idle_opens_a_block(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    t, rows = dt.datetime(2024, 1, 1), []
    for seq in range(200):
        t += dt.timedelta(microseconds=rng.choice([1, 10_000_000, 20_000_000, 20_000_001]))
        rows.append((rng.choice(["hot", "hot", "b"]), t, seq, rng.choice([1, 8, 20])))
    df = spark.createDataFrame([(b, ts, s, n) for b, ts, s, n in rows], "bucket string, ts timestamp, seq long, len long")
    got = pack(df, 128, ["ts", "seq"], 20_000_000, chunk_rows=chunk_rows)
    assert {(r.bucket, r.seq): (r.block, r.wal_pos) for r in got.collect()} == fold(rows, 128, 20_000_000)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "bucket string, seq long, len long"), 64, ["seq"]).count() == 0


def test_invariants(spark):
    rng = random.Random(5)
    rows = [("b", seq, rng.randrange(1, 50)) for seq in range(200)]
    placed = mf.object_offsets(roll_files(pack(spark.createDataFrame(rows, "bucket string, seq long, len long"), 64, ["seq"]), 64, 256))
    m = mf.block_manifest(placed, 64).collect()
    assert sum(r.expected_bytes for r in m) == sum(r[2] for r in rows)
    assert all(0 <= r.pad_bytes < 64 for r in m)
    assert sum(r.state == "OPEN" for r in m) == 1


def test_bad_sizes(spark):
    df = spark.createDataFrame([("b", 1, 1)], "bucket string, seq long, len long")
    with pytest.raises(ValueError):
        pack(df, 48, ["seq"])
    with pytest.raises(ValueError):
        roll_files(pack(df, 64, ["seq"]), 64, 64 * 512)


@pytest.mark.parametrize("fan, idle_us", [(2, None), (3, None), (2, 20_000_000)])
def test_levels_of_chunks_do_not_matter(spark, monkeypatch, fan, idle_us):
    from quarry.operators import pack as p

    monkeypatch.setattr(p, "FAN", fan)
    rng, t, rows = random.Random(fan), dt.datetime(2024, 1, 1), []
    for seq in range(240):
        t += dt.timedelta(microseconds=rng.choice([1, 10_000_000, 20_000_001] if idle_us else [1]))
        rows.append((rng.choice(["hot"] * 12 + ["a", "z"]), t, seq, rng.choice([8, 8, 8, 20, 52, 116])))
    df = spark.createDataFrame(rows, "bucket string, ts timestamp, seq long, len long")
    got = pack(df, 128, ["ts", "seq"], idle_us, chunk_rows=13)
    want = fold(rows if idle_us else [(b, s, n) for b, _, s, n in rows], 128, idle_us)
    assert {(r.bucket, r.seq): (r.block, r.wal_pos) for r in got.collect()} == want


def test_runs_of_one_size_never_agree(spark, monkeypatch):
    """500-byte frames in 8 MiB blocks: a table has a row for each record of a block, and few tables are ever together."""
    from pyspark.sql import functions as F

    from quarry.operators import pack as p

    monkeypatch.setattr(p, "FAN", 4)
    n, block = 120_000, 8 << 20
    df = spark.range(n).select(F.lit("b").alias("bucket"), F.col("id").alias("seq"), F.lit(485).cast("long").alias("len"))
    got = pack(df, block, ["seq"], chunk_rows=6_000)
    per = block // 500
    assert got.where((F.col("block") != F.floor(F.col("seq") / per)) | (F.col("wal_pos") != 500 * F.pmod("seq", F.lit(per)))).count() == 0
    assert got.count() == n


def test_outcomes_compose():
    """A run of chunks against the plain fold, for any bytes used on coming in."""
    import numpy as np

    from quarry.operators import pack as p

    rng, block = random.Random(1), 256
    for trial in range(150):
        idle = rng.choice([None, 5])
        chunks, at = [], 0
        for _ in range(rng.randint(1, 5)):
            sizes = np.array([rng.choice([16, 20, 32, 64, 100, 256]) if trial % 3 else 20 for _ in range(rng.randint(1, 30))])
            ts = np.cumsum([rng.choice([1, 2, 5, 6]) for _ in sizes]) + at
            cut, at = p.gaps(ts, idle, len(sizes)), int(ts[-1])
            after, k, g = p.next_opening(sizes, cut, block), 0, 0
            while after[k] < len(sizes):
                k, g = int(after[k]), g + 1
            chunks.append((sizes, ts, p.Outcome("b", "b", True, *p._transitions(sizes, cut, block), int(sizes.sum()), g, int(sizes[k:].sum()), int(ts[0]), int(ts[-1]))))
        whole = chunks[0][2]
        for *_, o in chunks[1:]:
            whole = whole.then(o, idle)
        for come in (0, 1, 50, 150, 255, 256):
            g, used, last = 0, come, None
            for sizes, ts, _ in chunks:
                for s, t in zip(sizes.tolist(), ts.tolist(), strict=True):
                    if used + s > block or (idle is not None and last is not None and t - last > idle):
                        g, used = g + 1, 0
                    used, last = used + s, t
            blocks, left = whole.after(np.array([come]))
            assert (int(blocks[0]), int(left[0])) == (g, used)


def test_chunks_are_small_and_stay_in_arrow(spark, monkeypatch):
    """A worker holds one chunk, as Arrow columns: 600,000 records are more than one, and rows are never Python objects."""
    from pyspark.sql import functions as F

    from quarry.operators import pack as module

    tables, real = {}, module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: tables.setdefault(name, real(df, name)))
    rows = spark.range(600_000).select(F.lit("a").alias("bucket"), F.col("id").alias("seq"), F.lit(20).cast("long").alias("len"))
    got = pack(rows, 64, ["seq"])
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "InPandas" not in plan
    assert tables["pack-chunks"].groupBy("chunk").count().agg(F.max("count")).first()[0] < 400_000
    assert got.where((F.col("block") == F.floor(F.col("seq") / 2)) & (F.col("wal_pos") == F.col("seq") % 2 * 32)).count() == 600_000
