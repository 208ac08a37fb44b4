"""Bounded samples of labelled rows, and the columns that both classifiers return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int, chars: int, id_col: str = "doc_id", text_col: str = "text"):
    """Texts and labels (0 or 1) of at most ``rows`` documents a class, and the shares of the classes among all labelled.

    Rows come in order of the MD5 of their id, which is the same for any partitioning, until there are ``rows`` of a class
    or its texts have ``chars`` characters together, whatever the length of each. Held-out rows are never read. Rows labelled twice count by
    their largest label; null labels and null texts don't count.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y")).where(~held_out)
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.md5(F.col(id_col).cast("string").cast("binary"))
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order).limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    got = texts.join(F.broadcast(ids), id_col).select(id_col, "text", F.col("y").cast("int").alias("y"))
    before = Window.partitionBy("y").orderBy(order, F.md5("text"))  # over ``rows`` rows, or as many as these ids have
    got = got.withColumns({"n": F.row_number().over(before), "upto": F.sum(F.length("text")).over(before.rowsBetween(Window.unboundedPreceding, -1))})
    got = got.where((F.col("n") <= rows) & (F.coalesce("upto", F.lit(0)) < chars)).orderBy("y", "n").select("text", "y").toPandas()
    n = sum(totals.values())
    return got["text"].tolist(), got["y"].to_numpy(dtype="float64"), (totals.get(1, 0) / n if n else 0.0)
