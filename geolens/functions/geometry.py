"""Planar polygon expressions.

A ring is ``array<struct<x,y>>``, closed or open.  Tests work on an edge list
(``array<struct<x1,y1,x2,y2>>``) that a caller builds once per polygon, before
any join, so that a joined row only folds over it.

Coordinates are decimals rounded to doubles, so whatever is no farther from an edge
than ``ROUNDING`` of the coordinates' size counts as on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolens.functions.scalar import let

ROUNDING = 2.0**-48  # 32 times the rounding of one double: vertices are sums, and a test has a few more steps


def ring_edges(ring: Column) -> Column:
    """Edges of one ring; the closing edge is added when the ring is open."""

    def closed(points: Column) -> Column:
        first = F.element_at(points, 1)
        return F.when(F.element_at(points, -1) == first, points).otherwise(F.concat(points, F.array(first)))

    def edges(points: Column) -> Column:
        heads = F.slice(points, F.lit(1), F.size(points) - 1)
        tails = F.slice(points, F.lit(2), F.size(points) - 1)
        return F.zip_with(
            heads,
            tails,
            lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
        )

    return F.when(F.size(ring) > 0, let(closed(ring), edges))


def polygon_edges(rings: Column) -> Column:
    """Edges of all rings of a polygon, holes included."""
    return F.flatten(F.transform(rings, ring_edges))


def ring_bbox(ring: Column) -> Column:
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


def _signed_sums(ring: Column) -> Column:
    """Twice the signed area and the two first moments, in one fold."""

    def add(acc: Column, e: Column) -> Column:
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (e["x1"] + e["x2"]) * cross).alias("mx"),
            (acc["my"] + (e["y1"] + e["y2"]) * cross).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(ring_edges(ring), zero, add)


def ring_area(ring: Column) -> Column:
    return F.abs(_signed_sums(ring)["a"]) / 2.0


def ring_centroid(ring: Column) -> Column:
    """Area centroid; the vertex mean for a ring without area."""

    def mean(axis: str) -> Column:
        total = F.aggregate(F.transform(ring, lambda p: p[axis]), F.lit(0.0), lambda acc, v: acc + v)
        return total / F.size(ring)

    def centroid(s: Column) -> Column:
        flat = s["a"] == 0.0
        return F.struct(
            F.when(flat, mean("x")).otherwise(s["mx"] / (3.0 * s["a"])).alias("x"),
            F.when(flat, mean("y")).otherwise(s["my"] / (3.0 * s["a"])).alias("y"),
        )

    return let(_signed_sums(ring), centroid)


def _reach(*values: Column) -> Column:
    """By how much rounding may displace the given values of one axis."""
    return F.greatest(*[F.abs(v) for v in values]) * F.lit(ROUNDING)


def side_of(e: Column, x: Column, y: Column) -> Column:
    """1 where the point is left of the directed edge, -1 right of it, 0 on its line up to rounding."""
    dx, dy, px, py = e["x2"] - e["x1"], e["y2"] - e["y1"], x - e["x1"], y - e["y1"]
    turn = dx * py - dy * px
    noise = _reach(e["x1"], e["x2"], x) * (F.abs(dy) + F.abs(py)) + _reach(e["y1"], e["y2"], y) * (F.abs(dx) + F.abs(px))
    return F.when(F.abs(turn) <= noise, F.lit(0.0)).otherwise(F.signum(turn))


def on_boundary(edges: Column, x: Column, y: Column) -> Column:
    def touches(e: Column) -> Column:
        near_x, near_y = _reach(e["x1"], e["x2"], x), _reach(e["y1"], e["y2"], y)
        return (
            x.between(F.least(e["x1"], e["x2"]) - near_x, F.greatest(e["x1"], e["x2"]) + near_x)
            & y.between(F.least(e["y1"], e["y2"]) - near_y, F.greatest(e["y1"], e["y2"]) + near_y)
            & (side_of(e, x, y) == 0)
        )

    return F.exists(edges, touches)


def crossing_parity(edges: Column, x: Column, y: Column) -> Column:
    """True when a ray to the right crosses the edges an odd number of times."""

    def crosses(e: Column) -> Column:
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        return ((e["y1"] > y) != (e["y2"] > y)) & F.when(e["y1"] != e["y2"], x < at).otherwise(False)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def contains_point(edges: Column, x: Column, y: Column) -> Column:
    """Strictly inside: a point on the boundary is outside."""
    return crossing_parity(edges, x, y) & ~on_boundary(edges, x, y)


def covers_point(edges: Column, x: Column, y: Column) -> Column:
    """Inside or on the boundary."""
    return crossing_parity(edges, x, y) | on_boundary(edges, x, y)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, ((x - x1) * dx + (y - y1) * dy) / length2).otherwise(F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def edges_intersect(a: Column, b: Column) -> Column:
    """True when some edge of ``a`` meets some edge of ``b`` (touching counts)."""

    def meet_along(axis: str, e: Column, f: Column) -> Column:
        first, last = f"{axis}1", f"{axis}2"
        near = _reach(e[first], e[last], f[first], f[last])
        return (F.greatest(e[first], e[last]) >= F.least(f[first], f[last]) - near) & (
            F.greatest(f[first], f[last]) >= F.least(e[first], e[last]) - near
        )

    def meets(e: Column, f: Column) -> Column:
        return (
            meet_along("x", e, f)
            & meet_along("y", e, f)
            & (side_of(e, f["x1"], f["y1"]) * side_of(e, f["x2"], f["y2"]) <= 0)
            & (side_of(f, e["x1"], e["y1"]) * side_of(f, e["x2"], e["y2"]) <= 0)
        )

    return F.exists(a, lambda e: F.exists(b, lambda f: meets(e, f)))


def polygon_from_wkt(text: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text, outer rings and holes alike."""

    def ring(body: Column) -> Column:
        def vertex(pair: Column) -> Column:
            def numbers(parts: Column) -> Column:
                return F.struct(
                    F.try_element_at(parts, F.lit(1)).cast("double").alias("x"),
                    F.try_element_at(parts, F.lit(2)).cast("double").alias("y"),
                )

            return let(F.split(F.trim(pair), r"\s+"), numbers)

        return F.transform(F.split(body, ","), vertex)

    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1), ring)


def box_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Closed ring of a box, starting at the upper right corner."""

    def corner(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(
        corner(max_x, max_y),
        corner(min_x, max_y),
        corner(min_x, min_y),
        corner(max_x, min_y),
        corner(max_x, max_y),
    )
