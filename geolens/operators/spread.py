"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolens.session import cut_lineage, range_tasks

ROWS_PER_TASK = 1_000_000


def keyed_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", condition: Column | None = None
) -> DataFrame:
    """Equi-join with an optional further condition that also decides outer matches."""
    if condition is None:
        return left.join(right, list(keys), how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = condition
    for k in keys:
        on = (F.col(k) == F.col(f"_r_{k}")) & on
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    condition: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join whose hot left keys are split over several tasks.

    For a left side that is cheap to read twice (a scan, a checkpointed table);
    elsewhere a plain join leaves hot partitions to adaptive execution.  Keys holding more than ``rows_per_task`` left rows are found by a partial
    aggregation; there are at most ``rows / rows_per_task`` of them, which is what
    bounds the broadcast below.  Their left rows are spread by a hash of
    ``spread_by`` and only their right rows are repeated.  ``how`` is inner, left,
    left_semi or left_anti; every right row outside ``keys`` needs its own name.
    """
    keys = list(keys)
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))
    )
    spread = list(spread_by or [c for c in left.columns if c not in keys] or keys)
    salt = F.pmod(F.xxhash64(*spread), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    right = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return keyed_join(left, right, [*keys, "_salt"], how, condition).drop("_salt")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None):
    """First ``k`` rows of each key.

    The row-number filter becomes a group limit on both sides of the shuffle, so a
    map task sends at most ``k`` rows of any key, however hot it is.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def global_index(df: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in a total order.

    Rows are range-partitioned and sorted, the result is written to the shared
    folder (range bounds are sampled, so they must not be drawn twice), and the
    per-range counts - one row per range - are summed and broadcast back.
    """
    tasks = range_tasks(df.sparkSession)
    placed = cut_lineage(
        df.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    part = F.shiftright("_m", 33)
    within = F.col("_m").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, within + F.col("_offset"))
        .drop("_p", "_m", "_offset")
    )


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` inside each group, hot groups included.

    Rows are range-partitioned by (group, order), so a hot group is cut into
    ranges; each range is summed on its own and the totals of the ranges before
    it are added.  At most one group is cut at each range bound, so the table of
    offsets has fewer rows than there are ranges.
    """
    group = list(group)
    tasks = range_tasks(df.sparkSession)
    placed = cut_lineage(
        df.withColumn("_v", value)
        .repartitionByRange(tasks, *[F.col(c) for c in group], *order)
        .withColumn("_p", F.spark_partition_id())
    )
    inside = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group) if group else Window.partitionBy()
    before = before.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_p", *group)
        .agg(F.sum("_v").alias("_total"))
        .withColumn("_offset", F.sum("_total").over(before))
        .where(F.col("_offset").isNotNull())
        .select(F.col("_p").alias("_op"), *[F.col(c).alias(f"_o_{c}") for c in group], "_offset")
    )
    on = F.col("_p") == F.col("_op")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return (
        placed.withColumn("_inside", F.sum("_v").over(inside))
        .join(F.broadcast(offsets), on, "left")
        .withColumn(name, F.col("_inside") + F.coalesce(F.col("_offset"), F.lit(0)))
        .drop("_p", "_v", "_inside", "_op", "_offset", *[f"_o_{c}" for c in group])
    )


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row inside its group."""
    return running_total(df, group, order, F.lit(1).cast("bigint"), name)
