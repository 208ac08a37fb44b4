"""Continuous packing: a stateful stream that assigns records of each bucket to blocks.

State per bucket is four numbers: open block, bytes used, object bytes, time of the last record. Payloads
never enter it. A micro-batch is sorted by (ts, seq) within its bucket, in runs on disk, so that a worker's
memory doesn't grow with it; a record opens a block where it doesn't fit or where the gap to the one before
is over the idle limit, as in batch packing, so results are the same when the micro-batches come in order.
Idle is judged on event times, which makes runs repeatable.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.pack import gaps, next_opening
from quarry.streaming.runs import in_order

OUTPUT = "bucket string, seq long, ts timestamp, len long, framed_size long, status string, block long, wal_pos long, object_offset long"
INPUT = pa.schema({"seq": pa.int64(), "ts": pa.timestamp("us"), "len": pa.int64(), "framed_size": pa.int64(), "status": pa.string()})
PAYLOAD = pa.field("payload", pa.binary())


class Packer(StatefulProcessor):
    """With ``payload``, a column of that name goes along; it never enters the state."""

    def __init__(self, block_bytes: int, idle_us: int | None, payload: bool = False):
        self.block_bytes, self.idle_us, self.payload = block_bytes, idle_us, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "block long, used long, bytes long, last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else (-1, 0, 0, None)
        for part in in_order(rows, INPUT.append(PAYLOAD) if self.payload else INPUT):
            state, result = self._place(key[0], part, state)
            yield result
        if state[3] is not None:
            self.state.update(state)

    def _place(self, bucket: str, part: pd.DataFrame, state: tuple) -> tuple[tuple, pd.DataFrame]:
        """The state after the rows of ``part``, which are in order, and their places."""
        block, used, held, last = state
        good = np.flatnonzero(part["status"] == "PUT_OK")
        us = part["ts"].to_numpy().astype("datetime64[us]").astype("int64")[good]
        sizes, lengths = (part[c].to_numpy()[good].astype(np.int64) for c in ("framed_size", "len"))
        n = len(good)
        total, upto = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, lengths))
        blocks, places, offsets = (np.zeros(n, np.int64) for _ in range(3))
        cut = gaps(us, self.idle_us, n)
        after = next_opening(sizes, cut, self.block_bytes)
        at = 0
        if n and last is not None:  # what still goes into the open block
            idle = self.idle_us is not None and us[0] - last > self.idle_us
            first_cut = 0 if idle else int(np.argmax(cut)) if cut.any() else n
            at = min(int(np.searchsorted(total, self.block_bytes - used, side="right")) - 1, first_cut)
            blocks[:at], places[:at], offsets[:at] = block, used + total[:at], held + upto[:at]
            used, held = used + int(total[at]), held + int(upto[at])
        while at < n:
            end, block = int(after[at]), block + 1
            blocks[at:end], places[at:end], offsets[at:end] = block, total[at:end] - total[at], upto[at:end] - upto[at]
            used, held, at = int(total[end] - total[at]), int(upto[end] - upto[at]), end
        if n:
            state = int(block), int(used), int(held), int(us[-1])
        result = part[["seq", "ts", "len", "framed_size", "status"]].assign(bucket=bucket)
        for c, values in (("block", blocks), ("wal_pos", places), ("object_offset", offsets)):
            result[c] = pd.Series(pd.NA, index=result.index, dtype="Int64")
            result.loc[good, c] = values
        if self.payload:
            result["payload"] = part["payload"]
        return state, result[[x.split()[0] for x in OUTPUT.split(", ")] + ["payload"] * self.payload]

    def close(self) -> None:
        pass


def pack_stream(records: DataFrame, block_bytes: int, idle_us: int | None = None) -> DataFrame:
    """A stream (bucket, seq, ts, len, framed_size, status and, if need be, payload) -> with block, wal_pos and object_offset."""
    payload = "payload" in records.columns
    return records.groupBy("bucket").transformWithStateInPandas(Packer(block_bytes, idle_us, payload), OUTPUT + ", payload binary" * payload, "Append", "None")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within, streams keep their state in the store that stateful processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def finish(query, timeout_s: int) -> None:
    """Waits for a stream over what its source has now; stops it at the deadline at the latest."""
    try:
        if not query.awaitTermination(timeout_s):
            raise TimeoutError("the stream did not end in time")
    finally:
        query.stop()


def run_available(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, timeout_s: int = 300) -> DataFrame:
    """Runs a stream over what its source has now, into Parquet; stops at the deadline at the latest."""
    with state_store(spark):
        finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(), timeout_s)
    return spark.read.schema(stream.schema).parquet(out)
