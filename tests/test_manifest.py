"""Pointers, states and configuration on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import manifest as mf


def test_pointers(spark):
    rows = [("a", i, s) for i, s in enumerate([3, 3, 1, 3])] + [("b", i, 3) for i in range(2)] + [("c", i, s) for i, s in enumerate([0, 3, 3])]
    df = spark.createDataFrame(rows, "file string, idx int, state int")
    up = {r.file: r.position for r in mf.upload_pointer(df, ["file"], "idx", "state", 8 << 20).collect()}
    assert up == {"a": 16777216, "b": 16777216, "c": 0}
    read = {r.file: r.position for r in mf.read_pointer(df, ["file"], "idx", "state", 8 << 20).collect()}
    assert read == {"a": 33554432, "b": 16777216, "c": 0}
    capped = {r.file: r.position for r in mf.upload_pointer(df, ["file"], "idx", "state", 8 << 20, F.col("idx") == 1).collect()}
    assert capped == {"a": 8388608, "b": 8388608, "c": 0}


def test_transitions(spark):
    states = ["OPEN", "SEALED", "UPLOADING", "FAILED", "UPLOADING", "SUCCESS", "OPEN"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "b int, i int, state string")
    got = [r.allowed for r in mf.check_transitions(df, ["b"], ["i"], "state").orderBy("i").collect()]
    assert got == [True, True, True, True, True, False]


def test_config_is_taken_whole(spark):
    buckets = spark.createDataFrame([("x",), ("y",)], "bucket string")
    special = spark.createDataFrame([("x", 5, None)], "bucket string, wal_size long, cache_size long")
    got = {r.bucket: (r.wal_size, r.cache_size) for r in mf.resolve_config(buckets, special, {"wal_size": 1, "cache_size": 2}).collect()}
    assert got == {"x": (5, None), "y": (1, 2)}


def test_idle(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("e", t), ("e", t + dt.timedelta(seconds=20)), ("e", t + dt.timedelta(seconds=40, microseconds=1))]
    got = mf.idle_sessions(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", "20 seconds").collect()
    assert sorted(r.records for r in got) == [1, 2]
    blocks = spark.createDataFrame([("a", "OPEN", t), ("b", "OPEN", t + dt.timedelta(microseconds=1)), ("c", "SEALED", t)], "bucket string, state string, last_ts timestamp")
    late = mf.idle_blocks(blocks, F.lit(t + dt.timedelta(seconds=1, microseconds=1)), 1_000_000).collect()
    assert [r.bucket for r in late] == ["a"]


def test_valid_prefix(spark):
    df = spark.createDataFrame([(0, 0, True), (0, 16, False), (0, 32, True), (1, 0, True)], "b int, pos int, ok boolean")
    assert {(r.b, r.pos) for r in mf.valid_prefix(df, ["b"], "pos", F.col("ok")).collect()} == {(0, 0), (1, 0)}


def test_task_queue(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "file_from_offset long, block_index int")
    assert {r.block_key for r in mf.distinct_tasks(df).collect()} == {258, 259}
