"""Versioned snapshots in plain Parquet folders.

``root/manifests``  one folder per ingested batch
``root/snapshots``  one folder per pointer and version, holding a full table or only a batch
``root/<pointer>``  one small JSON per version, naming its own folder

Data is written before its pointer, and a pointer is never changed, so a reader sees
either the old version or the new one.  Versions are ordered by a sequence number in
the pointer, then by id.  A known id with the same rows is a replay and changes
nothing; with other rows it is refused, as later versions may stand on its folder.

Writers need no lock.  A pointer names only what its writer added; the current table is
the newest base with all versions on top that the base does not hold.  Two writers at
once get the same number, neither names the other, and both batches count.  A base is a
full table: a version written whole, or the fold of what a writer saw when there were
many folders.  It lists the versions it holds, so one that it did not see stays on top.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolens.operators.spread import top_per_key
from geolens.operators.tables import ingest_report

KEYS = ("location_id", "heading")
LATEST = "_latest"
HOLDOUT = "_holdout"
# path: rows of this version; base: a full table holding the versions ``folded`` and those of the base of ``under``.
_POINTER = "run_id string, path string, base string, folded array<string>, under string, seq long, content string"


def new_run_id() -> str:
    """Time to the microsecond, and a few letters that keep writers of the same moment apart."""
    return "run_ts=" + datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H%M%S.%fZ-") + uuid.uuid4().hex[:6]


def write_batch_manifest(batch: DataFrame, root: str, run_id: str) -> str:
    path = f"{root}/manifests/run={run_id}"
    batch.write.mode("overwrite").parquet(path)
    return path


def _write_pointer(spark: SparkSession, root: str, pointer: str, entry: dict) -> None:
    row = spark.createDataFrame([entry], _POINTER)
    row.coalesce(1).write.mode("overwrite").json(f"{root}/{pointer}/version={entry['run_id']}")


def _entries(spark: SparkSession, root: str, pointer: str) -> list:
    """All versions, oldest first: one small row for each."""
    try:
        entries = spark.read.schema(_POINTER).json(f"{root}/{pointer}/version=*").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(entries, key=lambda e: (e["seq"], e["run_id"]))


def _pointer(spark: SparkSession, root: str, pointer: str):
    """Newest version."""
    return next(reversed(_entries(spark, root, pointer)), None)


def _current(entries: list):
    """The newest base, if any, and the versions on top of it, oldest first."""
    base = next((e for e in reversed(entries) if e["base"]), None)
    by_id, held, at = {e["run_id"]: e for e in entries}, set(), base
    while at is not None:
        held.update(at["folded"])
        at = by_id.get(at["under"])
    # A whole version that lost to a newer base was replaced by it, seen or not.
    return base, [e for e in entries if e["run_id"] not in held and e["base"] != e["path"]]


def _parts(entries: list) -> list[str]:
    base, top = _current(entries)
    return ([base["base"]] if base is not None else []) + [e["path"] for e in top]


def _content(df: DataFrame) -> str:
    """Digest of the rows and columns of a table, whatever their order."""
    names = sorted(df.columns)
    sums = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).first()
    return f"{sums[0]}:{sums[1] or 0}:{','.join(names)}"


def _published(entries: list, run_id: str, content: str) -> str | None:
    """Path of a run that was published before with the same rows; an error if it had others."""
    known = next((e for e in entries if e["run_id"] == run_id), None)
    if known is None:
        return None
    if known["content"] != content:
        raise ValueError(f"{run_id} was published with other rows; use a new run id")
    return known["path"]


def _entry(entries: list, run_id: str, path: str, content: str, base: str | None = None, own: bool = False) -> dict:
    """Pointer of a new version; a base holds all that is current, and its own rows if it is a whole version."""
    out = {"run_id": run_id, "path": path, "base": base, "folded": None, "under": None, "content": content}
    out["seq"] = entries[-1]["seq"] + 1 if entries else 0
    if base:
        under, top = _current(entries)
        out["folded"] = [e["run_id"] for e in top] + [run_id] * own
        out["under"] = under["run_id"] if under is not None else None
    return out


def _read_parts(spark: SparkSession, parts: list[str], keys=KEYS) -> DataFrame:
    if len(parts) == 1:
        return spark.read.option("mergeSchema", "true").parquet(parts[0])
    stacked = None
    for age, part in enumerate(parts):
        rows = spark.read.option("mergeSchema", "true").parquet(part).withColumn("_age", F.lit(age))
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    return top_per_key(stacked, keys, [F.col("_age").desc()]).drop("_age")


def snapshot_write(df: DataFrame, root: str, run_id: str | None = None, pointer: str = LATEST) -> str:
    """Write a full version and flip the pointer to it."""
    run_id, spark, content = run_id or new_run_id(), df.sparkSession, _content(df)
    if path := _published(_entries(spark, root, pointer), run_id, content):
        return path
    path = f"{root}/snapshots/{pointer.strip('_')}/{run_id}"
    df.write.mode("overwrite").parquet(path)
    _write_pointer(spark, root, pointer, _entry(_entries(spark, root, pointer), run_id, path, content, path, own=True))
    return path


def snapshot_read(spark: SparkSession, root: str, pointer: str = LATEST) -> DataFrame:
    """The current table; an error when there is none or it is empty."""
    entries = _entries(spark, root, pointer)
    if not entries:
        raise FileNotFoundError(f"no snapshot under {root}/{pointer}")
    snapshot = _read_parts(spark, _parts(entries))
    if snapshot.isEmpty():
        raise FileNotFoundError(f"snapshot {entries[-1]['run_id']} is empty")
    return snapshot


def publish_batch(
    batch: DataFrame, root: str, run_id: str, order: str | None = None, pointer: str = LATEST, compact_every: int = 16
) -> str:
    """Add a batch as a new version: newest row per key wins, within the batch the last.

    Publishing the same rows under the same ``run_id`` again changes nothing, so a
    replayed micro-batch is harmless; other rows under it are refused.
    """
    spark = batch.sparkSession
    if order is not None:
        batch = top_per_key(batch, KEYS, [F.col(order).desc()])
    content, entries = _content(batch), _entries(spark, root, pointer)
    if path := _published(entries, run_id, content):
        return path
    path = f"{root}/snapshots/{pointer.strip('_')}/{run_id}"
    batch.write.mode("overwrite").parquet(path)
    parts, base = _parts(entries), None
    if len(parts) + 1 >= compact_every and len(parts) > 1:
        base = f"{path}-base"
        _read_parts(spark, parts).write.mode("overwrite").parquet(base)
    _write_pointer(spark, root, pointer, _entry(entries, run_id, path, content, base))
    return path


def ingest_batch(
    batch: DataFrame, root: str, batch_date: str, run_id: str | None = None, order: str | None = None
) -> DataFrame:
    """Manifest, new version and report of one batch of upload records."""
    spark = batch.sparkSession
    run_id = run_id or new_run_id()
    dated = batch.withColumn("batch_date", F.lit(batch_date))
    manifest = write_batch_manifest(dated, root, run_id)
    stored = spark.read.parquet(manifest)
    publish_batch(stored, root, run_id, order)
    return ingest_report(stored, snapshot_read(spark, root))
