"""Next-fit packing of each bucket's records into blocks, in parallel within buckets.

A record that doesn't fit in what is left of the open block opens the next one; an exact fit stays. With
an idle limit a gap over it also opens the next block. That is a sequential fold, but one whose state
(open block, bytes used in it) is small, so it is done in three steps:

1. Records, without payloads, are range-partitioned by (bucket, order) into chunks of bounded size. Each
   chunk works out, for every state in which its bucket may come in, the state in which it goes out: a table
   with a row for each record of its first block at most, and few where runs that start differently soon agree.
2. The tables of FAN chunks are composed into one, those of FAN such groups again, and so on, on the executors, until
   FAN rows are left. The driver follows the state through these; each group, given its state, then does so for its
   members, level by level down to the chunks. No more than FAN tables are ever in one place.
3. Each chunk, given its state, assigns blocks and positions.

So a bucket with a third of all records is dealt out like any other. Records over a block's size, empty
and null payloads get status INVALID_ARGUMENT and no place.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.frames import MAX_BLOCKS_PER_FILE, framed_size, power_of_two
from quarry.plans.shared import materialize

CHUNK_ROWS, FAN = 250_000, 64


def with_status(records: DataFrame, block_bytes: int) -> DataFrame:
    """Adds framed_size and status to records with a payload length ``len`` (null for a null payload)."""
    framed = framed_size("len")
    ok = F.col("len").isNotNull() & (F.col("len") > 0) & (framed <= block_bytes)
    return records.withColumn("framed_size", framed).withColumn("status", F.when(ok, "PUT_OK").otherwise("INVALID_ARGUMENT"))


def next_opening(sizes: np.ndarray, cut: np.ndarray, block_bytes: int) -> np.ndarray:
    """For each record that opens a block: the record that opens the one after (len(sizes): none here)."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    full = np.searchsorted(total, total[:-1] + block_bytes, side="right") - 1
    cuts = np.append(np.flatnonzero(cut), n)
    return np.minimum(full, cuts[np.searchsorted(cuts, np.arange(n), side="right")])


def gaps(ts: np.ndarray | None, idle: int | None, n: int) -> np.ndarray:
    cut = np.zeros(n, bool)
    if idle is not None and n:
        cut[1:] = np.diff(ts) > idle
    return cut


class Outcome(NamedTuple):
    """What a run of chunks does to the state (blocks opened so far, bytes used, time of the last record) of its bucket.

    Coming in with ``used`` bytes, row k of the table with the largest ``least`` up to it says how many blocks are opened
    and how many bytes are used at the end; -1: none is opened, and the run's ``total`` is added. A run in more than one
    bucket (not ``single``) has no table, and its last bucket ends as ``fresh`` says, which is also how a single one
    ends whose first record opens a block that counts as the first.
    """

    first: str
    last: str
    single: bool
    least: np.ndarray
    blocks: np.ndarray
    used: np.ndarray
    total: int
    fresh_blocks: int
    fresh_used: int
    first_ts: int
    last_ts: int

    def after(self, used: np.ndarray, idle: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Blocks opened and bytes used for each way to come in; ``idle``: so late that a block is opened at once."""
        k = np.searchsorted(self.least, used, side="right") - 1
        blocks, left = self.blocks[k], np.where(self.used[k] < 0, used + self.total, self.used[k])
        return np.where(idle, 1 + self.fresh_blocks, blocks), np.where(idle, self.fresh_used, left)

    def then(self, other: Outcome, idle_us: int | None) -> Outcome:
        """This run, followed by the other."""
        if self.last != other.first or not other.single:
            return other._replace(first=self.first, single=False, first_ts=self.first_ts, least=NONE, blocks=NONE, used=NONE)
        idle = idle_us is not None and other.first_ts - self.last_ts > idle_us
        g, u = other.after(np.array([self.fresh_used]), idle)
        out = self._replace(last_ts=other.last_ts, total=self.total + other.total, fresh_blocks=self.fresh_blocks + int(g[0]), fresh_used=int(u[0]))
        if not self.single:
            return out
        least, blocks, used = self.least, self.blocks, self.used
        if used[0] < 0 and not idle:  # what opens nothing here meets each row of the other's table that it can come to
            more = other.least - self.total
            more = more[(more > least[0]) & (more < (least[1] if len(least) > 1 else 1 << 62))]
            least = np.concatenate([least[:1], more, least[1:]])
            blocks, used = (np.concatenate([np.repeat(x[:1], len(more) + 1), x[1:]]) for x in (blocks, used))
        come = np.where(used < 0, least + self.total, used)
        g, u = other.after(come, idle)
        if not idle:  # nothing opened in both
            u = np.where((used < 0) & (other.used[np.searchsorted(other.least, come, side="right") - 1] < 0), -1, u)
        blocks = blocks + g
        new = np.append(True, (blocks[1:] != blocks[:-1]) | (u[1:] != u[:-1]))
        return out._replace(least=least[new], blocks=blocks[new], used=u[new])


NONE = np.empty(0, np.int64)
OUTCOME = "chunk long, first string, last string, single boolean, least binary, blocks binary, used binary, total long, fresh_blocks long, fresh_used long, first_ts long, last_ts long"
OUTCOME_TYPES = pa.schema({name: {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind] for name, kind in (x.split() for x in OUTCOME.split(", "))})
STATE = "chunk long, known boolean, block long, used long, ts long"


def _row(chunk: int, o: Outcome) -> dict:
    return {"chunk": chunk} | {k: v.astype(np.int64).tobytes() if isinstance(v, np.ndarray) else v for k, v in o._asdict().items()}


def _outcomes(part: pd.DataFrame) -> list[tuple[int, Outcome]]:
    """(chunk, outcome) of each row, in order of chunk."""
    read = lambda f, v: np.frombuffer(v, np.int64) if f in ("least", "blocks", "used") else v
    return [(r["chunk"], Outcome(*(read(f, r[f]) for f in Outcome._fields))) for r in part.sort_values("chunk").to_dict("records")]


def _follow(outcomes: list[tuple[int, Outcome]], idle_us: int | None, bucket: str | None, state: tuple[int, int, int]) -> list[tuple]:
    """STATE rows: the state of ``bucket`` as it comes to each run; not known where the run's first bucket begins with it."""
    rows = []
    for chunk, o in outcomes:
        known = bucket is not None and o.first == bucket
        rows.append((chunk, known, *(state if known else (0, 0, 0))))
        if known and o.single:
            g, u = o.after(np.array([state[1]]), idle_us is not None and o.first_ts - state[2] > idle_us)
            state = (state[0] + int(g[0]), int(u[0]), o.last_ts)
        else:
            state = (o.fresh_blocks, o.fresh_used, o.last_ts)
        bucket = o.last
    return rows


def _states(level: DataFrame, n: int, idle_us: int | None) -> DataFrame:
    """OUTCOME rows numbered from 0 to n - 1 (some may lack) -> STATE rows."""
    spark = level.sparkSession
    if n <= FAN:
        return spark.createDataFrame(_follow(_outcomes(level.toPandas()), idle_us, None, (0, 0, 0)), STATE)  # FAN rows at most

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        every = _outcomes(part)
        whole = every[0][1]
        for _, o in every[1:]:
            whole = whole.then(o, idle_us)
        return pd.DataFrame([_row(every[0][0] // FAN, whole)])

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        one, every = part.iloc[0], _outcomes(part)
        rows = _follow(every, idle_us, every[0][1].first if one["known"] else None, (int(one["block"]), int(one["bytes"]), int(one["ts"])))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in STATE.split(", ")])

    group = F.floor(F.col("chunk") / F.lit(FAN))
    upper = materialize(level.groupBy(group.alias("g")).applyInPandas(compose, OUTCOME), "pack-outcomes")
    above = _states(upper, -(-n // FAN), idle_us).select(F.col("chunk").alias("g"), "known", "block", F.col("used").alias("bytes"), "ts")
    return level.withColumn("g", group).join(above, "g").groupBy("g").applyInPandas(follow, STATE)


def _in_order(part: pa.Table, order: list[str]) -> tuple[pa.Table, list[int]]:
    """The rows by (bucket, *order), and where each bucket begins, then their number."""
    keys = ["bucket", *order]
    part = part.take(pc.sort_indices(part.select(keys), sort_keys=[(k, "ascending") for k in keys], null_placement="at_end"))
    code = pc.fill_null(part["bucket"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
    return part, [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]


def _transitions(sizes: np.ndarray, cut: np.ndarray, block_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of an Outcome: where the first new block opens (record k, n for none) settles what follows."""
    n = len(sizes)
    after, total = next_opening(sizes, cut, block_bytes), np.concatenate([[0], np.cumsum(sizes)])
    # Pointer doubling: the last opening reached from each record, and how many openings on the way.
    hop = np.append(np.where(after < n, after, np.arange(n)), n)
    opened = (hop != np.arange(n + 1)).astype(np.int64)
    while (hop[hop] != hop).any():
        opened, hop = opened + opened[hop], hop[hop]
    first_cut = int(np.argmax(cut)) if cut.any() else n
    # Record k is the first that doesn't fit if the bytes used are over block_bytes - total[k + 1]; the first cut at the latest.
    k = np.arange(first_cut, -1, -1)
    least = np.where(k == first_cut, 0, block_bytes - total[np.minimum(k + 1, n)] + 1)
    k, least = k[least <= block_bytes], np.maximum(least[least <= block_bytes], 0)
    keep = np.append(least[1:] != least[:-1], True)  # of several from the same bytes on, the last one opens first
    k, least = k[keep], least[keep]
    blocks = np.where(k < n, opened[k] + 1, 0)
    used = np.where(k < n, total[n] - total[hop[k]], -1)
    new = np.append(True, (blocks[1:] != blocks[:-1]) | (used[1:] != used[:-1]))
    return least[new], blocks[new], used[new]


def pack(records: DataFrame, block_bytes: int, order: list[str], idle_us: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds framed_size, status, block (a number per bucket, from 0) and wal_pos to (bucket, *order, len).

    With ``idle_us``, the first of ``order`` is a timestamp.
    """
    power_of_two(block_bytes)
    judged = materialize(with_status(records, block_bytes), "pack-records")
    good = judged.where("status = 'PUT_OK'")
    names, schema = judged.columns, judged.withColumns({"block": F.lit(None).cast("long"), "wal_pos": F.lit(None).cast("long")}).schema
    bad = judged.where("status <> 'PUT_OK'").withColumn("block", F.lit(None).cast("long")).withColumn("wal_pos", F.lit(None).cast("long"))
    chunks = -(-good.count() // chunk_rows)
    if not chunks:
        return bad
    dealt = good.repartitionByRange(chunks, "bucket", *order).withColumn("chunk", F.spark_partition_id().cast("long"))
    dealt = materialize(dealt, "pack-chunks")

    def stamps(part: pa.Table) -> np.ndarray | None:
        return pc.fill_null(part[order[0]].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy() if idle_us is not None else None

    def survey(part: pa.Table) -> pa.Table:
        part, edges = _in_order(part, order)
        own = part.slice(edges[-2])
        sizes, ts = own["framed_size"].to_numpy(), stamps(own)
        cut = gaps(ts, idle_us, len(sizes))
        single = len(edges) == 2
        table = _transitions(sizes, cut, block_bytes) if single else (NONE, NONE, NONE)
        # coming in fresh: as if the first record opened a block
        after = next_opening(sizes, cut, block_bytes)
        at, g = 0, 0
        while after[at] < len(sizes):
            at, g = int(after[at]), g + 1
        times = (int(ts[0]), int(ts[-1])) if ts is not None else (0, 0)
        row = _row(part["chunk"][0].as_py(), Outcome(part["bucket"][0].as_py(), own["bucket"][0].as_py(), single, *table, int(sizes.sum()), g, int(sizes[at:].sum()), *times))
        return pa.Table.from_pylist([row], OUTCOME_TYPES)

    outcomes = materialize(dealt.select("chunk", "bucket", *order, "framed_size").groupBy("chunk").applyInArrow(survey, OUTCOME), "pack-outcomes")
    states = materialize(_states(outcomes, chunks, idle_us), "pack-states")

    def assign(part: pa.Table) -> pa.Table:
        known, g0, used, last = (part[c][0].as_py() for c in ("__known", "__block", "__used", "__ts"))
        part, edges = _in_order(part.select(names), order)
        sizes = part["framed_size"].to_numpy()
        block, pos = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for a, b in zip(edges, edges[1:], strict=False):
            own = sizes[a:b]
            ts = stamps(part.slice(a, b - a))
            cut = gaps(ts, idle_us, b - a)
            after = next_opening(own, cut, block_bytes)
            total = np.concatenate([[0], np.cumsum(own)])
            at, g = 0, 0
            if a == 0 and known:
                first_cut = 0 if idle_us is not None and ts[0] - last > idle_us else (int(np.argmax(cut)) if cut.any() else b - a)
                at = min(int(np.searchsorted(total, block_bytes - used, side="right")) - 1, first_cut)
                block[a : a + at], pos[a : a + at] = g0, used + total[:at]
                g = g0 + 1
            while at < b - a:
                end = int(after[at])
                block[a + at : a + end], pos[a + at : a + end] = g, total[at:end] - total[at]
                at, g = end, g + 1
        return part.append_column("block", pa.array(block)).append_column("wal_pos", pa.array(pos))

    told = dealt.join(states.select("chunk", *(F.col(c).alias(f"__{c}") for c in ("known", "block", "used", "ts"))), "chunk")
    return told.groupBy("chunk").applyInArrow(assign, schema).unionByName(bad)


def roll_files(packed: DataFrame, block_bytes: int, file_bytes: int) -> DataFrame:
    """Block numbers as (file_from_offset, block_index)."""
    per_file = file_bytes // power_of_two(block_bytes)
    if file_bytes % block_bytes or not 1 <= per_file <= MAX_BLOCKS_PER_FILE:
        raise ValueError(f"a file must hold 1 to {MAX_BLOCKS_PER_FILE} whole blocks")
    block = F.col("block")
    return packed.withColumn("file_from_offset", F.floor(block / F.lit(per_file)).cast("long") * F.lit(file_bytes)).withColumn("block_index", F.pmod(block, F.lit(per_file)).cast("int"))
