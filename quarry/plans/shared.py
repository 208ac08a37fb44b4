"""Tables that must outlive a stage, written where driver and executors both see them."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset and all runs in this process (master local), a
    temporary folder that goes at the end of the process; on a cluster that is an error, as others wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other call has, in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Removes all that this application has put in the shared folder: call it when its results have been read."""
    delete(spark, f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}")


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go as soon as the query that wrote them has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


class Scratch:
    """Tables of one operator in the shared folder, each written once and dropped when nothing reads it any more.

    Cuts lineage: a lost executor costs a re-read of a table, not a re-run of what made it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a scan of Parquet."""
        path = new_path(self.spark, name)
        with short_lived_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes the tables of these names, or all; only where no lazy result reads them."""
        for name in names or tuple(self.paths):
            for path in self.paths.pop(name, ()):
                delete(self.spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """One table that stays."""
    return Scratch(df.sparkSession).table(df, name)
