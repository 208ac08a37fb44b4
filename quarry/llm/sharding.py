"""Sharding by longest-processing-time scheduling (law ``bytes``).

Documents with equal texts form a group that stays together. Groups go, longest first, to the shard
with the least bytes so far. The heap runs on the driver over size classes instead of groups: a class
is one size up to 2^16 bytes and 1/1,024 of a power of two above, so there are at most 65,536 +
1,024 * 47 classes whatever the corpus holds. All groups of one class count as their mean, which is
exact for classes of one size and for a class of one group. How many groups of a class each shard
gets is settled in one step for whole rounds (raising the least loads to a common level) and by the
heap for the rest. Within a class groups are told apart by their rank, counted in salted ranges of
about RANGE groups, as many as the class needs, so that no task sees a whole class.

Defined cases: a null text counts 0 bytes, has CRC 0 and is in one group with the empty text; rows
repeated under one id are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.shared import materialize

OVERHEAD = 8  #: bytes that each row counts besides its text
EXACT_BITS, FINE_BITS, RANGE, BLOCKS = 16, 10, 50_000, 512


def size_class(size):
    """A whole number per class, rising with the size."""
    bits = F.floor(F.log2(size.cast("double"))).cast("int")
    cut = F.greatest(bits - FINE_BITS, F.lit(0))
    return F.when(size < 1 << EXACT_BITS, size).otherwise(F.call_function("shiftleft", F.call_function("shiftright", size, cut), cut))


def schedule(classes: list[tuple[int, int, float]], shards: int) -> dict[int, list[int]]:
    """(class, groups, mean size) -> how many groups of the class each shard gets, by LPT."""
    heap = [(0.0, j) for j in range(shards)]
    dealt = {}
    for key, groups, mean in sorted(classes, reverse=True):
        counts, left = [0] * shards, groups
        if left > 4 * shards and mean > 0:  # whole rounds at once: fill up to a level that leaves some groups for the heap
            loads = sorted(heap)
            level, n, total = 0.0, 0, 0.0
            for i, (load, _) in enumerate(loads):
                total += load
                level = (left * mean + total) / (i + 1)
                n = i + 1
                if n == shards or level <= loads[n][0]:
                    break
            for load, j in loads[:n]:
                counts[j] = max(0, int((level - load) / mean) - 1)
            left -= sum(counts)
            heap = [(load + counts[j] * mean, j) for load, j in loads]
            heapq.heapify(heap)
        for _ in range(left):
            load, j = heapq.heappop(heap)
            counts[j] += 1
            heapq.heappush(heap, (load + mean, j))
        dealt[key] = counts
    return dealt


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    utf8 = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = materialize(docs.select(F.col(id_col).alias("id"), (F.octet_length(utf8).cast("long") + OVERHEAD).alias("size"), F.crc32(utf8).alias("text_crc32"), F.unhex(F.md5(utf8)).alias("digest")), "shard-rows")
    groups = materialize(slim.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes"))), "shard-groups")
    per = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()  # bounded: a row a class
    dealt = schedule([(r["class"], r["n"], r["bytes"] / r["n"]) for r in per], shards)
    table = spark.createDataFrame([(r["class"], -(-r["n"] // RANGE), np.cumsum(dealt[r["class"]]).tolist()) for r in per], "class long, ranges int, ends array<long>")
    salted = groups.join(F.broadcast(table), "class").withColumn("range", F.pmod(F.hash("digest"), F.col("ranges")))  # 113,000 classes at most
    counts = salted.groupBy("class", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("class", "range", (F.sum("n").over(Window.partitionBy("class").orderBy("range")) - F.col("n")).alias("start"))  # a row for RANGE groups
    rank = F.row_number().over(Window.partitionBy("class", "range").orderBy("bytes", "digest")) - 1 + F.col("start")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    placed = salted.join(starts, ["class", "range"]).withColumn("rank", rank).select("digest", shard.alias("shard"))

    rows = materialize(slim.join(placed, "digest").select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int").alias("block")), "shard-placed")
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))  # bounded: shards * BLOCKS rows
    offsets = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "size", "text_crc32")) - 1
    return rows.join(F.broadcast(offsets), ["shard", "block"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + within).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
