"""Ingestion as a stream of files.

Both streams run a batch write per micro-batch.  The stream and the batch number name
what is written, so a replayed micro-batch meets itself and a stream begun anew with
another checkpoint, which counts from zero again, does not meet the old one's batches.
A stream is told by ``stream_id``, or else by the place of its checkpoint.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geolens.sources.snapshots import publish_batch, write_batch_manifest


def read_file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _stream_id(stream_id: str | None, checkpoint: str) -> str:
    return stream_id or hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def stream_ingest(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    order: str = "ord",
    prefix: str = "run_ts=stream",
    compact_every: int = 16,
    stream_id: str | None = None,
) -> StreamingQuery:
    """Per micro-batch: manifest, latest-wins merge, new version."""
    own = _stream_id(stream_id, checkpoint)

    def publish(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{prefix}-{own}-{batch_id:010d}"
        manifest = write_batch_manifest(batch, root, run_id)
        publish_batch(batch.sparkSession.read.parquet(manifest), root, run_id, order, compact_every=compact_every)

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


LEDGERS = {"collected": True, "failed": False}


def stream_ledgers(
    stream: DataFrame, root: str, checkpoint: str, flag: str = "ok", stream_id: str | None = None
) -> StreamingQuery:
    """Append every micro-batch's points to the ledger of successes or failures."""
    own = _stream_id(stream_id, checkpoint)

    def append(batch: DataFrame, batch_id: int) -> None:
        split = batch.select("lat", "lon", F.coalesce(F.col(flag), F.lit(False)).alias("ok")).distinct().persist()
        for name, wanted in LEDGERS.items():
            rows = split.where(F.col("ok") == F.lit(wanted)).select("lat", "lon")
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={own}-{batch_id:010d}")
        split.unpersist()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Distinct points of a ledger."""
    return spark.read.parquet(f"{root}/{name}").select("lat", "lon").distinct()
