"""Spatial joins as equi-joins on grid keys.

One side gets the key of the grid square it lies in, the other side the keys of
every square its box (or search ball) touches.  A pair meets in exactly one
square, so nothing has to be deduplicated afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolens.operators.spread import keyed_join, salted_join, top_per_key
from geolens.session import cut_lineage


# A square whose candidate list is longer than this is searched on a finer grid.
LONG_LIST = 256
MAX_DEPTH = 8


def square(value: Column, size: float | Column) -> Column:
    return F.floor(value / size).cast("bigint")


def with_point_key(df: DataFrame, axes: Sequence[Column], size: float, prefix: str = "g") -> DataFrame:
    return df.withColumns({f"{prefix}{i}": square(axis, size) for i, axis in enumerate(axes)})


def with_box_keys(
    df: DataFrame, lows: Sequence[Column], highs: Sequence[Column], size: float | Column, prefix: str = "g"
) -> DataFrame:
    """One row per grid square touched by the box [lows, highs]."""
    for i, (low, high) in enumerate(zip(lows, highs)):
        df = df.withColumn(f"{prefix}{i}", F.explode(F.sequence(square(low, size), square(high, size))))
    return df


def grid_join(
    points: DataFrame,
    boxes: DataFrame,
    axes: Sequence[Column],
    lows: Sequence[Column],
    highs: Sequence[Column],
    size: float,
    condition: Column,
    keys: Sequence[str] = (),
    how: str = "inner",
    salt: bool = False,
) -> DataFrame:
    """Join points to the boxes around them; ``condition`` is the exact test.

    ``keys`` are further equality keys both sides share (for example a parent
    region).  Crowded squares are split by adaptive execution, or salted up front
    with ``salt`` where the points can be read twice cheaply.
    """
    left = with_point_key(points, axes, size)
    right = with_box_keys(boxes, lows, highs, size)
    squares = [f"g{i}" for i in range(len(axes))]
    join = salted_join if salt else keyed_join
    return join(left, right, [*keys, *squares], how, condition=condition).drop(*squares)


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [(p - q) * (p - q) for p, q in zip(a, b)]))


def nearest_candidates(
    queries: DataFrame,
    items: DataFrame,
    dims: int,
    size: float,
    levels: int,
    slack: float = 0.0,
    depth: int = 0,
) -> DataFrame:
    """Pairs that are certain to include the nearest item of every query.

    ``queries`` has coordinates q0..qn, ``items`` has i0..in; an item may reach up
    to ``slack`` beyond its coordinates (pieces of a boundary).  The search is
    run once per occupied square instead of once per query:

    1. a pyramid of coarser squares keeps one item per square; looking around the
       square's centre on every level gives some item at distance ``u``;
    2. the nearest item of any query in the square lies within ``u`` plus the
       square's diagonal of the centre (triangle inequality), so a ball join of
       the square centres with the items yields a short list per square;
    3. queries pick up the list of their square.  Squares with a long list, where
       items crowd, are searched again on a finer grid instead.

    No item is left out, so the nearest one found among the pairs is exact.

    The estimated size of an exploded table is that of its source, so the joins are told not to broadcast one.
    """
    axes = range(dims)
    diagonal = size * dims**0.5
    q, i, c, r = ([F.col(f"{p}{a}") for a in axes] for p in ("q", "i", "c", "r"))
    cell_keys = [f"g{a}" for a in axes]

    keyed = with_point_key(queries, q, size)
    cells = (
        keyed.select(*cell_keys)
        .distinct()
        .withColumns({f"c{a}": (F.col(f"g{a}") + F.lit(0.5)) * F.lit(size) for a in axes})
    )

    level_ids = F.array(*[F.lit(level) for level in range(levels + 1)])
    level_size = F.lit(size) * F.pow(F.lit(2.0), F.col("lv"))
    squares = [f"s{a}" for a in axes]

    # 1. one representative per square and level, then an upper bound per cell.
    reps = items.withColumn("lv", F.explode(level_ids)).withColumns(
        {f"s{a}": square(F.col(f"i{a}"), level_size) for a in axes}
    )
    # Any item of the square will do: it only shapes the search radius, never the result.
    reps = reps.groupBy("lv", *squares).agg(*[F.first(f"i{a}").alias(f"r{a}") for a in axes])
    around = cells.withColumn("lv", F.explode(level_ids))
    around = with_box_keys(around, [v - level_size for v in c], [v + level_size for v in c], level_size, "s")
    bound = (
        around.join(reps.hint("merge"), ["lv", *squares])
        .groupBy(*cell_keys)
        .agg(F.min(distance(c, r) + F.lit(slack)).alias("u"))
    )

    # 2. ball join of the cell centres with the items, on the level fitting the radius.
    reach = F.col("u") + F.lit(diagonal + slack)
    fit = F.greatest(F.lit(0), F.ceil(F.log2(reach / F.lit(size)))).cast("int")
    balls = cells.join(bound, cell_keys).withColumn("reach", reach).withColumn("lv", F.least(fit, F.lit(levels)))
    balls = with_box_keys(balls, [v - F.col("reach") for v in c], [v + F.col("reach") for v in c], level_size, "s")
    spots = items.withColumn("lv", F.explode(level_ids)).withColumns(
        {f"s{a}": square(F.col(f"i{a}"), level_size) for a in axes}
    )
    lists = spots.hint("merge").join(balls, ["lv", *squares]).where(distance(i, c) <= F.col("reach"))
    lists = lists.drop("lv", "u", "reach", *squares, *[f"c{a}" for a in axes])

    # 3. short lists are handed out, crowded squares go on with finer squares.  The
    # rows of a square asked for most are split over tasks by adaptive execution.
    lists = cut_lineage(lists)
    long = lists.groupBy(*cell_keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG_LIST)
    long = cut_lineage(long.select(*cell_keys))
    if slack > 0 or depth >= MAX_DEPTH or long.isEmpty():
        return keyed.hint("merge").join(lists, cell_keys).drop(*cell_keys)
    short = keyed.hint("merge").join(lists.join(long.hint("merge"), cell_keys, "left_anti"), cell_keys).drop(*cell_keys)
    crowded = cut_lineage(keyed.join(long.hint("merge"), cell_keys, "left_semi").drop(*cell_keys))
    finer = nearest_candidates(crowded, items, dims, size / 16.0, levels + 4, slack, depth + 1)
    return short.unionByName(finer)


def nearest(
    queries: DataFrame,
    items: DataFrame,
    query_key: Sequence[str],
    score: Column,
    tie: Sequence[Column],
    dims: int,
    size: float,
    levels: int,
    slack: float = 0.0,
    score_name: str = "distance",
) -> DataFrame:
    """Exact nearest item per query under ``score``, ties broken by ``tie``."""
    pairs = nearest_candidates(queries, items, dims, size, levels, slack).withColumn(score_name, score)
    return top_per_key(pairs, query_key, [F.col(score_name).asc(), *tie])
