"""Polygons cut along grid squares, so that a joined row carries only the edges of its own square.

A polygon becomes one row per square of its box.  A row has the edges that touch the (closed) square and the parity
of one point of it, the lower right corner: whether a ray to the right from there crosses the outline an odd number
of times.  A square without edges lies fully inside or outside; those outside are dropped.  Squares with more than
``LOCAL_EDGES`` edges are cut into quarters until none has, the corner of a quarter getting its parity from the edges
of the square above it.

Whether a point is inside follows from the corner: walk from the point straight right to the square's border, then
down the border to the corner, and count the edges crossed.  All of them touch the square.  Corners and vertices may
coincide, as regions often follow the grid; therefore both counts use one symbolic shift of all points, to the
right and by much less upwards, which is what the usual half-open rules say, and orientations instead of quotients.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolens.functions.geometry import ROUNDING, edges_intersect, on_boundary
from geolens.operators.octagons import is_octagon, meeting_octagons, with_extents
from geolens.operators.spread import keyed_join, salted_join
from geolens.session import cut_lineage

LOCAL_EDGES = 128
DEEPEST = 24  # quarters of quarters at most: vertices that many edges share can't be told apart by squares
_BOX = ("min_x", "min_y", "max_x", "max_y")


def _turn(e: Column, x: Column, y: Column) -> Column:
    """Positive where the point is left of the directed edge, zero on its line."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _right_of_point(e: Column, x: Column, y: Column) -> Column:
    """For an edge that spans the height y: it passes to the right of the point."""
    return F.when(e["y2"] > e["y1"], _turn(e, x, y) > 0).otherwise(_turn(e, x, y) < 0)


def _above_point(e: Column, x: Column, y: Column) -> Column:
    """For an edge that spans the place x: it passes above the point, just right of it where it goes through it."""
    turn = _turn(e, x, y)
    onward = e["x2"] > e["x1"]
    rising = (e["y2"] > e["y1"]) == onward
    return F.when(turn == 0, rising & (e["y1"] != e["y2"])).otherwise(F.when(onward, turn < 0).otherwise(turn > 0))


def corner_parity(local: Column, odd: Column, right: Column, low: Column, x: Column, y: Column) -> Column:
    """Parity at a point of the square with lower right corner (right, low), whose own parity is ``odd``."""

    def crossed(e: Column) -> Column:
        across = ((e["y1"] > y) != (e["y2"] > y)) & _right_of_point(e, x, y) & ~_right_of_point(e, right, y)
        down = ((e["x1"] > right) != (e["x2"] > right)) & (_above_point(e, right, y) != _above_point(e, right, low))
        return across != down  # crossed once, not both or none

    return odd != (F.size(F.filter(local, crossed)) % 2 == 1)


def _squares_of(low: Column, high: Column, size: Column | float) -> Column:
    """Numbers of the closed squares that touch [low, high], up to the rounding of its ends."""
    low, high = low - F.abs(low) * F.lit(ROUNDING), high + F.abs(high) * F.lit(ROUNDING)
    return F.sequence((F.ceil(low / size) - 1).cast("bigint"), F.floor(high / size).cast("bigint"))


def _edge_rows(edges: DataFrame, size: float) -> DataFrame:
    """Every edge in every row of squares it touches, with the part of it there."""
    e = F.col("e")
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    return edges.withColumn("g1", F.explode(_squares_of(low, high, size))).withColumns(
        {"_a": F.greatest(low, F.col("g1") * size), "_b": F.least(high, (F.col("g1") + 1) * size)}
    )


def _local_edges(edges: DataFrame, size: float) -> DataFrame:
    e = F.col("e")
    rise = e["y2"] - e["y1"]

    def at(y: Column) -> Column:
        along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(rise != 0, (y - e["y1"]) / rise)))
        return e["x1"] + along * (e["x2"] - e["x1"])

    spare = F.lit(size * 1e-9)  # an edge too many does no harm
    level = rise == 0
    left = F.when(level, F.least(e["x1"], e["x2"])).otherwise(F.least(at(F.col("_a")), at(F.col("_b"))) - spare)
    right = F.when(level, F.greatest(e["x1"], e["x2"])).otherwise(F.greatest(at(F.col("_a")), at(F.col("_b"))) + spare)
    placed = _edge_rows(edges, size).withColumn("g0", F.explode(_squares_of(left, right, size)))
    return placed.groupBy("_pid", "g0", "g1").agg(F.collect_list("e").alias("local"))


def _crossings(edges: DataFrame, size: float) -> DataFrame:
    """How many edges cross the lower border of each square strictly right of its left corner, up to its right corner."""
    e = F.col("e")
    y = F.col("g1") * size
    rows = _edge_rows(edges, size).where((e["y1"] > y) != (e["y2"] > y))
    guess = (F.ceil((e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])) / size) - 1).cast("bigint")
    rows = rows.withColumn("_g", guess)
    beyond = _right_of_point(e, (F.col("_g") + 1) * F.lit(size), y)
    short = ~_right_of_point(e, F.col("_g") * F.lit(size), y)
    rows = rows.withColumn("g0", F.col("_g") + F.when(beyond, 1).when(short, -1).otherwise(0))
    return rows.groupBy("_pid", "g1", "g0").agg(F.count(F.lit(1)).alias("n"))


def _quartered(squares: DataFrame) -> DataFrame:
    """The four quarters of each square (one level further down) that are not fully outside."""
    half = F.col("_size") / 2
    quarters = F.array(*[F.struct((F.col("g0") * 2 + i).alias("g0"), (F.col("g1") * 2 + j).alias("g1")) for i in (0, 1) for j in (0, 1)])
    cut = squares.withColumn("_q", F.explode(quarters)).withColumns({"_h": half, "_x": (F.col("_q.g0") + 1) * half, "_y": F.col("_q.g1") * half})
    x0, x1, y0, y1 = F.col("_x") - F.col("_h"), F.col("_x"), F.col("_y"), F.col("_y") + F.col("_h")

    def touches(e: Column) -> Column:
        spare = F.lit(1e-9) * F.abs(e["x2"] - e["x1"]) * F.col("_h") + F.lit(1e-9) * F.abs(e["y2"] - e["y1"]) * F.col("_h")
        turns = F.array(*[_turn(e, x, y) for x in (x0, x1) for y in (y0, y1)])
        return (
            (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0)
            & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
            & (F.array_min(turns) <= spare) & (F.array_max(turns) >= -spare)
        )

    right, low = (F.col("g0") + 1) * F.col("_size"), F.col("g1") * F.col("_size")
    cut = cut.withColumns({"_odd": corner_parity(F.col("local"), F.col("odd"), right, low, F.col("_x"), F.col("_y")), "_local": F.filter("local", touches)})
    out = cut.select("_pid", (F.col("lv") + 1).alias("lv"), F.col("_q.g0").alias("g0"), F.col("_q.g1").alias("g1"), F.col("_h").alias("_size"), F.col("_local").alias("local"), F.col("_odd").alias("odd"))
    return out.where((F.size("local") > 0) | F.col("odd"))


def clip(polygons: DataFrame, size: float = 4.0, local_edges: int | None = LOCAL_EDGES) -> tuple[DataFrame, list[int], float]:
    """The polygons' squares (lv, g0, g1, local, odd and the columns of ``polygons`` but edges and box), the levels
    there are, and the size of squares of level 0: the largest power of two up to ``size``, which keeps borders exact.
    Without ``local_edges`` all squares are of level 0.
    """
    power = 1.0
    while power > size:
        power /= 2
    while power * 2 <= size:
        power *= 2
    size = power
    keyed = cut_lineage(polygons.withColumn("_pid", F.monotonically_increasing_id()))
    edges = keyed.select("_pid", F.explode("edges").alias("e"))
    box = keyed.select("_pid", F.explode(_squares_of(F.col("min_x"), F.col("max_x"), size)).alias("g0"), *_BOX)
    box = box.withColumn("g1", F.explode(_squares_of(F.col("min_y"), F.col("max_y"), size))).drop(*_BOX)
    known = box.join(_local_edges(edges, size), ["_pid", "g0", "g1"], "left").withColumn("n", F.lit(0).cast("bigint"))
    counts = _crossings(edges, size).withColumn("local", F.lit(None).cast(known.schema["local"].dataType))
    both = known.withColumn("_square", F.lit(True)).unionByName(counts.withColumn("_square", F.lit(False)))
    # A row of squares of one polygon: as many rows as the polygon's box has columns, twice at most.
    farther = Window.partitionBy("_pid", "g1").orderBy((-F.col("g0")).alias("_o")).rangeBetween(Window.unboundedPreceding, -1)
    squares = both.withColumn("odd", F.coalesce(F.sum("n").over(farther), F.lit(0)) % 2 == 1).where("_square")
    squares = squares.where(F.col("local").isNotNull() | F.col("odd"))
    squares = squares.select(
        "_pid", F.lit(0).alias("lv"), "g0", "g1", F.lit(size).alias("_size"), F.coalesce("local", F.array().cast(known.schema["local"].dataType)).alias("local"), "odd"
    )
    done, levels = cut_lineage(squares), [0]
    crowded = F.size("local") > (local_edges or 0)
    if local_edges is not None and not done.where(crowded).isEmpty():
        open_, kept = done.where(crowded), [done.where(~crowded)]
        while levels[-1] < DEEPEST:
            below = cut_lineage(_quartered(open_))
            levels.append(levels[-1] + 1)
            kept.append(below.where(~crowded))
            open_ = below.where(crowded)
            if open_.isEmpty():
                break
        kept.append(open_)
        done = kept[0]
        for more in kept[1:]:
            done = done.unionByName(more)
    return done.join(keyed.drop("edges", *_BOX), "_pid").drop("_pid"), levels, size


def inside(x: Column, y: Column, boundary: bool) -> Column:
    """Whether the point is inside the polygon of its square; on the outline: ``boundary``."""
    right, low = (F.col("g0") + 1) * F.col("_size"), F.col("g1") * F.col("_size")
    parity = corner_parity(F.col("local"), F.col("odd"), right, low, x, y)
    on = on_boundary(F.col("local"), x, y)
    return parity | on if boundary else parity & ~on


def meeting_pairs(cells: DataFrame, key: str, name: str, size: float) -> DataFrame:
    """(key, src, dst): cells of one key whose shapes meet, each pair once, in either order.

    Octagons are settled by their extents; pairs with another shape by their squares.
    """
    known = cells.select(key, name, "edges", *_BOX, is_octagon(F.col("edges")).alias("_octagon"))
    shapes = cut_lineage(with_extents(known).drop("edges", *_BOX)).dropna(subset=[key, name, "lo_x", "lo_y"])
    pairs = meeting_octagons(shapes.where("_octagon"), key, name)
    if not shapes.where(~F.col("_octagon")).isEmpty():
        pairs = pairs.unionByName(_meeting_outlines(known, key, name, size))
    if shapes.groupBy(key, name).count().where("count > 1").isEmpty():
        return pairs
    # Several rows of one name: its parts.
    ends = {"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}
    return pairs.withColumns(ends).distinct()


def _meeting_outlines(cells: DataFrame, key: str, name: str, size: float) -> DataFrame:
    """Pairs that are not both octagons, from their squares alone.

    Shapes meet if edges meet, which happens in a square that has both edges, or if one holds a part of the other;
    then a vertex of that part is inside the other one's square.
    """
    squares, _, side = clip(_around_outlines(cut_lineage(cells), key, name, size), size, local_edges=None)
    joined = [key, "g0", "g1"]
    a, b = (squares.select(*joined, "_size", *[F.col(c).alias(f"{p}_{c}") for c in (name, "_octagon", "local", "odd")]) for p in "ab")
    once = F.col("b__octagon") | (F.col(f"a_{name}") < F.col(f"b_{name}"))
    both = a.where(~F.col("a__octagon")).join(b.drop("_size"), joined).where(once & (F.col(f"a_{name}") != F.col(f"b_{name}")))
    right, low = (F.col("g0") + 1) * F.col("_size"), F.col("g1") * F.col("_size")

    def holds(outer: str, inner: str) -> Column:
        local, odd = F.col(f"{outer}_local"), F.col(f"{outer}_odd")

        def vertex(e: Column) -> Column:
            x, y = e["x1"], e["y1"]
            here = (x <= right) & (x >= right - side) & (y >= low) & (y <= low + side)
            return here & (corner_parity(local, odd, right, low, x, y) | on_boundary(local, x, y))

        return F.exists(f"{inner}_local", vertex)

    meets = edges_intersect(F.col("a_local"), F.col("b_local")) | holds("a", "b") | holds("b", "a")
    return both.where(meets).select(key, F.col(f"a_{name}").alias("src"), F.col(f"b_{name}").alias("dst")).distinct()


def _around_outlines(cells: DataFrame, key: str, name: str, size: float) -> DataFrame:
    """Cells that are no octagons, and the octagons that have a square of their boxes in common with one of them."""
    others, octagons = cells.where(~F.col("_octagon")), cells.where("_octagon")

    def squares(df: DataFrame, *columns: str) -> DataFrame:
        for i, axis in enumerate("xy"):
            df = df.withColumn(f"g{i}", F.explode(_squares_of(F.col(f"min_{axis}"), F.col(f"max_{axis}"), size)))
        return df.select(*columns, key, "g0", "g1").distinct()

    near = squares(octagons, name).join(squares(others), [key, "g0", "g1"], "left_semi").select(key, name).distinct()
    return others.unionByName(octagons.join(near, [key, name], "left_semi"))


def clipped_join(
    points: DataFrame,
    polygons: DataFrame,
    size: float,
    boundary: bool,
    keys: Sequence[str] = (),
    how: str = "inner",
    salt: bool = False,
) -> DataFrame:
    """Points (lon, lat) with the polygons that contain them, by equality of ``keys`` and squares.

    ``polygons`` has edges and box (:func:`geolens.operators.spatial.polygon_table`).  A left join keeps a point that
    is in no polygon once.
    """
    squares, levels, size = clip(polygons, size)
    if levels == [0]:
        return _at_level_0(points, squares, size, boundary, keys, how, salt)
    # Leaves lie on several levels: each place is looked up once on each of them, and a left join gets its points back.
    spots = points.select("lon", "lat", *keys).dropna().distinct()
    hits = settle(spots, squares, levels, size, boundary, keys)
    return salted_join(points, hits, ["lon", "lat", *keys], how) if salt else points.join(hits, ["lon", "lat", *keys], how)


def settle(
    points: DataFrame, squares: DataFrame, levels: list[int], size: float, boundary: bool, keys: Sequence[str] = ()
) -> DataFrame:
    """Points (lon, lat) with the polygons that contain them, for squares that :func:`clip` made once for many joins."""
    if levels == [0]:
        return _at_level_0(points, squares, size, boundary, keys)
    keyed = points.withColumn("lv", F.explode(F.array(*[F.lit(v) for v in levels])))
    keyed = keyed.withColumns(_square_at(size, F.col("lv")))
    found = keyed_join(keyed, squares, [*keys, *_PLACE], "inner", condition=inside(F.col("lon"), F.col("lat"), boundary))
    return found.drop(*_PLACE, *_CONTENT)


_PLACE, _CONTENT = ("lv", "g0", "g1"), ("_size", "local", "odd")


def _square_at(size: float, level: Column) -> dict[str, Column]:
    side = F.lit(size) / F.pow(F.lit(2.0), level)
    return {"g0": F.floor(F.col("lon") / side).cast("bigint"), "g1": F.floor(F.col("lat") / side).cast("bigint")}


def _at_level_0(points, squares, size, boundary, keys=(), how="inner", salt=False) -> DataFrame:
    keyed = points.withColumn("lv", F.lit(0)).withColumns(_square_at(size, F.lit(0)))
    join = salted_join if salt else keyed_join
    found = join(keyed, squares, [*keys, *_PLACE], how, condition=inside(F.col("lon"), F.col("lat"), boundary))
    return found.drop(*_PLACE, *_CONTENT)
