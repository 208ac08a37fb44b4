"""The packing stream over several micro-batches against batch packing."""

import datetime as dt
import random

from quarry.operators.pack import pack, with_status
from quarry.streaming import blocks as st


def test_micro_batches_equal_the_batch(spark, tmp_path):
    rng, t, rows = random.Random(9), dt.datetime(2024, 1, 1), []
    for seq in range(240):
        t += dt.timedelta(seconds=rng.choice([1, 5, 20, 21, 90]))
        rows.append((rng.choice(["a", "a", "b"]), seq, t, rng.choice([None, 0, 4, 9, 30, 200])))
    schema = "bucket string, seq long, ts timestamp, len long"
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = st.run_available(spark, st.pack_stream(with_status(source, 128), 128, 20_000_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {(r.bucket, r.seq): (r.block, r.wal_pos, r.status) for r in out.collect()}
    want = pack(spark.createDataFrame(rows, schema), 128, ["ts", "seq"], 20_000_000)
    assert got == {(r.bucket, r.seq): (r.block, r.wal_pos, r.status) for r in want.collect()}


def test_uploads_over_micro_batches(spark, tmp_path):
    """Blocks go up when a later one has sealed them, the rest at the end, each once and whole."""
    from pyspark.sql import functions as F

    from quarry.operators import manifest as mf
    from quarry.operators.pack import roll_files
    from quarry.sources import objects as ob
    from quarry.streaming import upload

    rng, t, rows = random.Random(4), dt.datetime(2024, 1, 1), []
    for seq in range(150):
        t += dt.timedelta(seconds=rng.choice([1, 5, 20, 21, 90]))
        rows.append((rng.choice(["a", "a", "b"]), seq, t, bytearray(rng.randbytes(rng.choice([0, 4, 9, 30, 200])))))
    schema = "bucket string, seq long, ts timestamp, payload binary"
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    judged = lambda df: with_status(df.withColumn("len", F.octet_length("payload").cast("long")), 128)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    uploader = upload.Uploader(spark, f"{tmp_path}/up", 128, 512, "p", "m", "i", 20_000_000, uploads=2)
    acks = upload.ingest(judged(source), uploader, f"{tmp_path}/checkpoint").collect()
    every = spark.createDataFrame(rows, schema)
    placed = roll_files(pack(judged(every).drop("payload"), 128, ["ts", "seq"], 20_000_000), 128, 512).join(every.select("seq", "payload"), "seq")
    want = {(r.bucket, r.file_from_offset, r.block_index): bytes(r.content) for r in mf.concat_blocks(placed).collect()}
    assert len(acks) == len(want) and all(r.verified for r in acks)
    stored = {r.s3_key: bytes(r.content) for r in ob.read_objects(spark, uploader.objects).collect()}
    assert {(r.bucket, r.file_from_offset, r.block_index): stored[r.s3_key] for r in acks} == want
    assert sorted(r.bucket for r in acks if r.sealed_by == "CLOSE") == ["a", "b"]
    assert {r.sealed_by for r in acks} == {"SIZE", "IDLE", "CLOSE"}


def test_a_large_group_is_placed_in_pieces(monkeypatch):
    """A group of many runs leaves in frames of a few runs at most, with the places of one frame of all its rows."""
    import numpy as np
    import pandas as pd

    from quarry.streaming import runs

    rng = np.random.default_rng(3)
    n = 5_000
    rows = pd.DataFrame({"seq": rng.permutation(n), "ts": pd.to_datetime(rng.integers(0, 900, n) * 7, unit="s"), "len": rng.integers(1, 40, n).astype(float)})
    rows.loc[rng.random(n) < 0.05, "len"] = np.nan
    rows["framed_size"] = (rows["len"] + 15) // 4 * 4
    rows["status"] = np.where(rows["len"].isna() | (rows["framed_size"] > 48), "INVALID_ARGUMENT", "PUT_OK")
    rows["payload"] = [None if x != x else bytes([k % 251]) * int(x) for k, x in enumerate(rows["len"])]

    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, x: setattr(self, "value", x)

    def placed(idle):
        packer = st.Packer(128, idle, payload=True)
        packer.state = State()
        frames = [*packer.handleInputRows(("a",), (rows[k : k + 300] for k in range(0, n, 300)), None)]
        return frames, packer.state.value

    for idle in (None, 6_000_000):
        (whole,), end = placed(idle)
        with monkeypatch.context() as m:
            for name, value in (("RUN_ROWS", 64), ("RUN_BYTES", 4_000), ("FAN", 4)):
                m.setattr(runs, name, value)
            parts, same = placed(idle)
        assert max(map(len, parts)) <= 64 * 12 and same == end  # FAN runs of each of three levels
        assert whole[["ts", "seq"]].equals(whole[["ts", "seq"]].sort_values(["ts", "seq"])) and len(whole) == n
        pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole, check_dtype=False)


def test_payloads_bound_a_run(monkeypatch):
    """Large payloads end a run and a piece by their bytes, long before the rows do."""
    import pandas as pd

    from quarry.streaming import runs

    monkeypatch.setattr(runs, "RUN_BYTES", 64_000)
    monkeypatch.setattr(runs, "FAN", 8)
    n = 400
    rows = pd.DataFrame({"seq": range(n)[::-1], "ts": pd.Timestamp("2024-01-01"), "len": 1_000, "framed_size": 1_012, "status": "PUT_OK", "payload": [bytes([k % 251]) * 1_000 for k in range(n)][::-1]})
    parts = [*runs.in_order((rows[k : k + 10] for k in range(0, n, 10)), st.INPUT.append(st.PAYLOAD))]
    assert len(parts) > 3 and max(p["len"].sum() for p in parts) < 3 * 64_000
    got = pd.concat(parts, ignore_index=True)
    assert got["seq"].tolist() == [*range(n)] and got["payload"].tolist() == rows["payload"].tolist()[::-1]
