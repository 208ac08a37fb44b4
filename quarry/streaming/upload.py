"""Continuous ingestion to the end: packing, upload of sealed blocks after each micro-batch, closing.

A micro-batch is packed (streaming.blocks); its records and those of blocks not yet uploaded make the pending table.
Blocks that a later one of their bucket has sealed are put as objects, verified and acknowledged, and leave the pending
table; the open ones wait in it for the next micro-batch. Closing seals and uploads what is left. Every step writes
tables named by its micro-batch from those of the one before, and puts replace whole objects under keys that follow from
the block, so that a micro-batch that runs again after a failure has the same outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.frames import object_key
from quarry.operators import manifest as mf
from quarry.operators.pack import roll_files
from quarry.sources import objects as ob
from quarry.streaming.blocks import finish, pack_stream, state_store

ACKS = "bucket string, file_from_offset long, block_index int, s3_key string, bytes long, sealed_by string, verified boolean"


class Uploader:
    """Uploads of one stream, below ``root``: objects, pending/<batch>, acks/<batch>."""

    def __init__(self, spark: SparkSession, root: str, block_bytes: int, file_bytes: int, prefix: str, machine: str, instance: str, idle_us: int | None = None, uploads: int | None = None):
        self.spark, self.root, self.block_bytes, self.file_bytes = spark, root.rstrip("/"), block_bytes, file_bytes
        self.prefix, self.machine, self.instance, self.idle_us, self.uploads = prefix, machine, instance, idle_us, uploads
        self.objects, self.last = f"{self.root}/objects", -1
        ob.register(spark)

    def _put(self, rows: DataFrame, manifest: DataFrame, batch: int) -> None:
        """Uploads the sealed blocks among ``manifest`` and acknowledges those that verify."""
        key = object_key(F.lit(self.prefix), self.machine, self.instance, "bucket", "file_from_offset", "block_index")
        sealed = manifest.where("state = 'SEALED'").select(*mf.BLOCK, key.alias("s3_key"), F.col("expected_bytes").alias("bytes"), "sealed_by")
        ob.write_objects(mf.concat_blocks(rows.join(sealed.select(*mf.BLOCK), mf.BLOCK, "left_semi")).join(sealed, mf.BLOCK), self.objects, self.uploads)
        checked = ob.verify_uploads(sealed, self.objects).select("s3_key", "verified")
        sealed.join(checked, "s3_key").select([x.split()[0] for x in ACKS.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/acks/{batch}")

    def batch(self, packed: DataFrame, batch: int) -> None:
        """One micro-batch of placements with payloads."""
        new = roll_files(packed.where("status = 'PUT_OK'"), self.block_bytes, self.file_bytes)
        before = f"{self.root}/pending/{batch - 1}"
        rows = new.unionByName(self.spark.read.schema(new.schema).parquet(before)) if batch else new
        pending = f"{self.root}/pending/{batch}-all"
        rows.write.mode("overwrite").parquet(pending)
        rows = self.spark.read.schema(new.schema).parquet(pending)
        manifest = mf.block_manifest(rows, self.block_bytes, ts="ts", idle_us=self.idle_us)
        self._put(rows, manifest, batch)
        acked = self.acks(batch).where("verified").select(*mf.BLOCK)
        rows.join(acked, mf.BLOCK, "left_anti").write.mode("overwrite").parquet(f"{self.root}/pending/{batch}")
        self.last = batch

    def close(self) -> None:
        """Seals and uploads what is left."""
        if self.last >= 0:
            rows = self.spark.read.parquet(f"{self.root}/pending/{self.last}")
            manifest = mf.block_manifest(rows, self.block_bytes, ts="ts", idle_us=self.idle_us)
            self._put(rows, mf.seal_all(manifest, self.block_bytes), self.last + 1)

    def acks(self, batch: int | str = "*") -> DataFrame:
        return self.spark.read.schema(ACKS).parquet(f"{self.root}/acks/{batch}")


def ingest(records: DataFrame, uploader: Uploader, checkpoint: str, timeout_s: int = 600) -> DataFrame:
    """A stream (bucket, seq, ts, len, framed_size, status, payload), run over what its source has now, uploaded and closed;
    returns the acknowledgements, one row a block."""
    packed = pack_stream(records, uploader.block_bytes, uploader.idle_us)
    with state_store(uploader.spark):
        finish(packed.writeStream.foreachBatch(uploader.batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(), timeout_s)
    uploader.close()
    return uploader.acks()
