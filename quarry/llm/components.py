"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step replaces edges by edges to the least neighbour; groups are only ever reduced to a minimum
(combined before the shuffle), never gathered, so a vertex may have any number of neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.shared import Scratch, materialize

ROWS = 500_000  #: edges in one file of a step


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (id, component) of every id that has one: the least id it reaches."""
    scratch = Scratch(edges.sparkSession)
    e = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            out = materialize(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "components")
            scratch.drop()
            return out
        before = now
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        e = scratch.table(small.coalesce(1 + now["n"] // ROWS), "cc-edges")
