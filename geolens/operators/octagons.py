"""Pairs of octagons that meet: polygons whose sides run along the axes or the diagonals, as boxes and diamonds do.

Two convex polygons are apart only if a line along a side of one of them separates them.  Sides of octagons have four
directions at most, so two octagons meet if their extents overlap along x, y, x + y and x - y.  A pair is four overlaps
of numbers then, and its edges are not needed.

A pair of octagons overlaps in squares that lie in a rectangle.  It is formed in the first of them only: the column in
which the later one starts and the row in which the later one starts.  So no pair comes twice and none is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolens.functions.geometry import ROUNDING
from geolens.functions.scalar import let

CROWD = 4096  # squares with more rows are compared in blocks of this many
MOST_EDGES = 64  # so that roundings of many short edges can't add up
AXES = ("x", "y", "u", "v")
EXTENTS = tuple(f"{end}_{axis}" for axis in AXES for end in ("lo", "hi"))


def _heading(e: Column) -> Column:
    """Direction of an edge in eighths of a turn, east 0 and north 2; NULL for any other."""

    def steps(d: Column) -> Column:
        east = F.when(F.abs(d["x"]) <= d["near_x"], F.lit(0.0)).otherwise(F.signum(d["x"]))
        north = F.when(F.abs(d["y"]) <= d["near_y"], F.lit(0.0)).otherwise(F.signum(d["y"]))
        slanted = F.abs(F.abs(d["x"]) - F.abs(d["y"])) <= d["near_x"] + d["near_y"]
        return F.struct(east.alias("east"), north.alias("north"), slanted.alias("slanted"))

    def eighths(d: Column) -> Column:
        east, north = d["east"], d["north"]
        level = F.when(east != 0, F.lit(2.0) - east * 2.0)
        return F.when(north == 0, level).when(east == 0, F.lit(4.0) - north * 2.0).when(d["slanted"], F.lit(4.0) - north * (east + 2.0))

    away = F.struct(
        (e["x2"] - e["x1"]).alias("x"),
        (e["y2"] - e["y1"]).alias("y"),
        (F.greatest(F.abs(e["x1"]), F.abs(e["x2"])) * ROUNDING).alias("near_x"),
        (F.greatest(F.abs(e["y1"]), F.abs(e["y2"])) * ROUNDING).alias("near_y"),
    )
    return let(let(away, steps), eighths)


def is_octagon(edges: Column) -> Column:
    """Whether the edges are one convex ring along the axes and diagonals: it turns once, always to one side."""

    def turned(items: Column) -> Column:
        return F.concat(F.slice(items, F.lit(2), F.size(items) - 1), F.slice(items, 1, 1))

    def once(turns: Column) -> Column:
        left = F.aggregate(turns, F.lit(0.0), lambda total, turn: total + turn)
        return (left == 8) | (left == F.size(F.filter(turns, lambda turn: turn != 0)) * 8 - 8)

    def turns(headings: Column) -> Column:
        return F.zip_with(headings, turned(headings), lambda a, b: F.pmod(b - a, F.lit(8.0)))

    def ring(moves: Column) -> Column:
        closed = F.zip_with(moves, turned(moves), lambda a, b: (a["x2"] == b["x1"]) & (a["y2"] == b["y1"]))
        one = let(let(F.transform(moves, _heading), turns), once)
        return F.when(F.size(moves).between(2, MOST_EDGES), F.forall(closed, lambda c: c) & one)

    moves = F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    return F.coalesce(let(moves, ring), F.lit(False))


def with_extents(polygons: DataFrame) -> DataFrame:
    """Adds the extents along the four axes, wider by the rounding of the coordinates."""
    far = {axis: F.greatest(F.abs(F.col(f"min_{axis}")), F.abs(F.col(f"max_{axis}"))) for axis in "xy"}
    far["u"] = far["v"] = far["x"] + far["y"]
    sums = F.transform("edges", lambda e: e["x1"] + e["y1"])
    differences = F.transform("edges", lambda e: e["x1"] - e["y1"])
    ends = {"x": (F.col("min_x"), F.col("max_x")), "y": (F.col("min_y"), F.col("max_y"))}
    ends |= {axis: (F.array_min(v), F.array_max(v)) for axis, v in (("u", sums), ("v", differences))}
    return polygons.withColumns(
        {f"{end}_{axis}": ends[axis][i] + sign * far[axis] * ROUNDING for axis in AXES for i, (end, sign) in enumerate((("lo", -1), ("hi", 1)))}
    )


def _square_size(octagons: DataFrame) -> float | None:
    """Near the usual extent, and such that an octagon has six squares on average at most; a power of two is exact."""
    w, h = F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")
    sides = octagons.agg(F.avg(w), F.avg(h), F.sqrt(F.avg(w * h))).first()
    return None if sides[0] is None else 2.0 ** round(math.log2(max(sides)))


def meeting_octagons(octagons: DataFrame, key: str, name: str) -> DataFrame:
    """(key, src, dst): pairs of octagons of one key that meet, each once, in either order.

    ``octagons`` is a written table with ``key``, ``name`` and the columns of :func:`with_extents`.  Rows of one name
    don't meet.  A square with more than ``CROWD`` rows is compared in blocks, each of which can be another task's.
    """
    size = _square_size(octagons)
    if size is None:
        return octagons.select(key, F.col(name).alias("src"), F.col(name).alias("dst"))
    first = {axis: F.floor(F.col(f"lo_{axis}") / size) for axis in "xy"}
    rows = octagons
    for axis in "xy":
        rows = rows.withColumn(f"g_{axis}", F.explode(F.sequence(first[axis], F.floor(F.col(f"hi_{axis}") / size))))
        rows = rows.withColumn(f"starts_{axis}", F.col(f"g_{axis}") == first[axis])
    place = [key, "g_x", "g_y"]
    # As few as rows / CROWD squares, which bounds the broadcast.
    crowds = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD)
    rows = rows.join(F.broadcast(crowds), place, "left")
    parts = F.coalesce(F.ceil(F.col("_n") / CROWD), F.lit(1))
    rows = rows.withColumns({"_own": F.pmod(F.xxhash64(name), parts), "_other": F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))})

    def side(prefix: str, own: str, other: str) -> DataFrame:
        taken = [F.col(c).alias(f"{prefix}_{c}") for c in (name, "starts_x", "starts_y", *EXTENTS)]
        return rows.select(*place, F.col("_own").alias(own), F.col("_other").alias(other), *taken)

    a, b = side("a", "_p", "_q").where("a_starts_x"), side("b", "_q", "_p")
    a_name, b_name = F.col(f"a_{name}"), F.col(f"b_{name}")
    met = (~F.col("b_starts_x") | (a_name < b_name)) & (F.col("a_starts_y") | F.col("b_starts_y")) & (a_name != b_name)
    for axis in AXES:
        met = met & (F.col(f"a_lo_{axis}") <= F.col(f"b_hi_{axis}")) & (F.col(f"b_lo_{axis}") <= F.col(f"a_hi_{axis}"))
    return a.join(b.hint("merge"), [*place, "_p", "_q"]).where(met).select(key, a_name.alias("src"), b_name.alias("dst"))
