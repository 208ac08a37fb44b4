"""Rows of one key in order, in bounded memory: sorted runs on disk, merged piece by piece.

A group of a micro-batch can be larger than a worker's memory, and Spark sorts no streams. Runs are files without a name
in the task's temporary folder, gone with the task however it ends.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

RUN_ROWS, RUN_BYTES, FAN = 131_072, 32 << 20, 64  #: a run, its payloads, and how many are merged at a time
LATEST = np.iinfo(np.int64).max


def _keys(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """ts and seq as numbers, nulls last."""
    return tuple(pc.fill_null(rows[c].cast(pa.int64()), LATEST).to_numpy() for c in ("ts", "seq"))


def _sorted(rows: pa.Table) -> pa.Table:
    ts, seq = _keys(rows)
    return rows.take(np.lexsort((seq, ts)))


class Run:
    """Sorted rows in a file, read in pieces of a FANth of a run."""

    def __init__(self, tables: Iterable[pa.Table], schema: pa.Schema):
        self.file, self.rows = tempfile.TemporaryFile(), schema.empty_table()
        step = max(1, RUN_ROWS // FAN)
        with pa.ipc.new_stream(self.file, schema) as out:
            for t in tables:
                fit = RUN_BYTES // FAN * t.num_rows // max(1, t.nbytes)
                out.write_table(t.combine_chunks(), max_chunksize=max(1, min(step, fit)))
        self.file.seek(0)
        self.pieces, self.step, self.more = pa.ipc.open_stream(self.file), step, True

    def fill(self) -> None:
        """At least one more piece, and small ones up to a whole one, unless the file is at its end."""
        parts = [self.rows]
        while self.more and (n := sum(p.num_rows for p in parts)) < self.step and (not n or sum(p.nbytes for p in parts) < RUN_BYTES // FAN):
            try:
                parts.append(pa.Table.from_batches([self.pieces.read_next_batch()]))
            except StopIteration:
                self.more = False
                self.file.close()
        self.rows = pa.concat_tables(parts)
        self.keys = _keys(self.rows)

    def take(self, bound: tuple[int, int] | None) -> pa.Table:
        """What there is in memory up to the bound."""
        ts, seq = self.keys
        n = len(ts)
        if bound is not None:
            a, b = np.searchsorted(ts, bound[0], side="left"), np.searchsorted(ts, bound[0], side="right")
            n = int(a + np.searchsorted(seq[a:b], bound[1], side="right"))
        out, self.rows = self.rows.slice(0, n), self.rows.slice(n)
        return out


def _merged(runs: list[Run]) -> Iterator[pa.Table]:
    while runs:
        for r in runs:
            r.fill()
        bound = min(((int(r.keys[0][-1]), int(r.keys[1][-1])) for r in runs if r.more), default=None)
        taken = pa.concat_tables([r.take(bound) for r in runs])
        if taken.num_rows:
            yield _sorted(taken)
        runs = [r for r in runs if r.more or r.rows.num_rows]


def in_order(frames: Iterator[pd.DataFrame], schema: pa.Schema) -> Iterator[pd.DataFrame]:
    """Rows by (ts, seq), in frames of about a run at most. The runs of a level are merged when there are FAN."""
    levels, held, rows, size = [], [], 0, 0

    def spill(tables: Iterable[pa.Table], level: int) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append(Run(tables, schema))
        if len(levels[level]) == FAN:
            full, levels[level] = levels[level], []
            spill(_merged(full), level + 1)

    for f in frames:
        part = pa.Table.from_pandas(f[schema.names], schema=schema, preserve_index=False)
        for at in range(0, part.num_rows, RUN_ROWS):
            held.append(part.slice(at, RUN_ROWS))
            rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
            if rows >= RUN_ROWS or size >= RUN_BYTES:
                spill([_sorted(pa.concat_tables(held))], 0)
                held, rows, size = [], 0, 0
    if held and not levels:
        yield _sorted(pa.concat_tables(held)).to_pandas()
        return
    if held:
        spill([_sorted(pa.concat_tables(held))], 0)
    for t in _merged([r for level in levels[::-1] for r in level]):
        yield t.to_pandas()
