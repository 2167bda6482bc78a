"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings every job of this package relies on.  Skew splitting, runtime
# broadcast decisions and partition coalescing are left to adaptive execution;
# no size is hard-wired to a particular cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "geolens", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geolens-"))
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Later rounds neither recompute it nor lose it with an executor.  A table also
    brings its true size along, whereas a checkpointed plan keeps the estimate of
    the joins behind it, which squares with every round of a loop.
    """
    spark = df.sparkSession
    path = work_path(spark, "cut")
    df.write.parquet(path)
    return written(spark, path, df.schema)


def written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of the shared folder, whose frame remembers its place for ``discard``."""
    df = spark.read.schema(schema).parquet(path)
    df._scratch = path
    return df


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by ``cut_lineage`` that no plan reads any more.

    For tables whose successors are written themselves: a plan that is still to run must not read them, and a
    frame derived from such a table (or any other frame) is left alone.
    """
    for df in tables:
        path = df.__dict__.pop("_scratch", None) if df is not None else None
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    The cleaner follows garbage collections of the driver, which are rare there; between the large steps of one
    job, shuffles whose results are written would otherwise stay on the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def range_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
