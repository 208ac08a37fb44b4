"""Columns by name, whatever stands in the name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of this name, dots and backticks in it taken as they are."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """The same with columns c0, c1, ...: functions over Arrow batches don't take names with dots. toDF() names them again."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
