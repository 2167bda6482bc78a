"""Clipped polygons against an exact test on whole outlines."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolens.operators import clipped, octagons, spatial

RINGS = "array<array<struct<x:double,y:double>>>"


def exactly(rings, x, y):
    """1 inside, 0 on the outline, -1 outside; in whole numbers and fractions."""
    inside = False
    for ring in rings:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        for (ax, ay), (bx, by) in zip(closed, closed[1:]):
            ax, ay, bx, by, px, py = map(Fraction, (ax, ay, bx, by, x, y))
            turn = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            if turn == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
                return 0
            if (ay > py) != (by > py) and (turn > 0) == (by > ay):
                inside = not inside
    return 1 if inside else -1


def star(rng, n, grid):
    """A ring around a centre, its vertices on a grid: edges along squares, through corners, of no length."""
    cx, cy = rng.randint(-6, 6), rng.randint(-6, 6)
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    out = [(round((cx + math.cos(t) * rng.uniform(1, 9)) / grid) * grid, round((cy + math.sin(t) * rng.uniform(1, 9)) / grid) * grid) for t in turns]
    return [(float(a), float(b)) for a, b in out]


def polygons_of(spark, shapes):
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in enumerate(shapes)]
    return spatial.polygon_table(spark.createDataFrame(rows, f"name int, rings {RINGS}"))


@pytest.mark.parametrize(("size", "local", "grid"), [(4.0, 128, 1), (1.0, 128, 1), (2.0, 3, 1), (4.0, 2, 0.5), (16.0, 4, 0.25), (3.0, 128, 2)])
def test_points_and_outlines_on_a_grid(spark, monkeypatch, size, local, grid):
    monkeypatch.setattr(clipped, "LOCAL_EDGES", local)
    monkeypatch.setattr(clipped.clip, "__defaults__", (4.0, local))
    monkeypatch.setattr(clipped, "DEEPEST", 6)
    rng = random.Random(int(size * 100 + local))
    shapes = [[star(rng, rng.randint(3, 14), grid)] for _ in range(14)]
    shapes += [[[(-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0)], [(-4.0, -4.0), (4.0, -4.0), (4.0, 4.0), (-4.0, 4.0), (-4.0, -4.0)]]]
    places = [(x / 2, y / 2) for x in range(-24, 25) for y in range(-24, 25)] + [(rng.uniform(-14, 14), rng.uniform(-14, 14)) for _ in range(300)]
    want = {(k, x, y): exactly(r, x, y) for k, r in enumerate(shapes) for x, y in places}
    points = spark.createDataFrame(places, "lon double, lat double")
    for boundary in (False, True):
        got = clipped.clipped_join(points, polygons_of(spark, shapes), size, boundary).select("name", "lon", "lat").collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == {p for p, w in want.items() if w > 0 or (boundary and w == 0)}


def test_rows_of_a_long_outline_carry_local_edges_only(spark):
    n = 100_000
    ring = [(20 * math.cos(2 * math.pi * i / n) * (1 + 0.2 * math.sin(700 * math.pi * i / n)), 20 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    table = polygons_of(spark, [[ring]])
    squares, levels, size = clipped.clip(table, 4.0)
    sizes = squares.select("lv", F.size("local").alias("n")).collect()
    assert size == 4.0 and max(levels) > 2
    assert max(r["n"] for r in sizes) <= clipped.LOCAL_EDGES
    assert n <= sum(r["n"] for r in sizes) < 1.5 * n
    assert any(r["n"] == 0 for r in sizes)  # squares fully inside
    rng = random.Random(1)
    places = [(rng.uniform(-25, 25), rng.uniform(-21, 21)) for _ in range(60)]
    points = spark.createDataFrame([(*p, i) for i, p in enumerate(places)], "lon double, lat double, k int")
    got = {r["k"] for r in clipped.clipped_join(points, table, 4.0, False).collect()}
    a = np.array(ring)
    b = np.roll(a, -1, axis=0)
    turn = lambda x, y: (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    crossed = [((a[:, 1] > y) != (b[:, 1] > y)) & ((turn(x, y) > 0) == (b[:, 1] > a[:, 1])) for x, y in places]
    assert got == {i for i, c in enumerate(crossed) if c.sum() % 2}


def test_left_join_on_several_levels(spark, monkeypatch):
    monkeypatch.setattr(clipped.clip, "__defaults__", (4.0, 2))
    shapes = [[[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (1.0, 1.5), (0.0, 3.0)]], [[(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]]]
    named = polygons_of(spark, shapes).withColumn("label", F.concat(F.lit("p"), F.col("name").cast("string"))).drop("name")
    rows = [(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 2.5, 0.5), (3, 1.0, 2.0), (4, None, 0.5), (5, 50.0, 50.0)]
    points = spark.createDataFrame(rows, "k int, lon double, lat double")
    got = sorted((r["k"], r["label"]) for r in spatial.join_within(points, named, "label").collect())
    assert got == [(1, "p0"), (1, "p0"), (1, "p1"), (1, "p1"), (2, "p0"), (3, "UNKNOWN"), (4, "UNKNOWN"), (5, "UNKNOWN")]


def test_no_polygons_and_empty_rings(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "k int, lon double, lat double")
    none = polygons_of(spark, [[[]], []])
    assert clipped.clipped_join(points, none, 4.0, True).count() == 0
    assert clipped.clipped_join(points, none.limit(0), 4.0, True, how="left").count() == 1


def test_octagons_are_told_from_other_outlines(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    diamond = [(-2.1, 0.3), (0.3, -2.1), (2.7, 0.3), (0.3, 2.7), (-2.1, 0.3)]
    yes = [
        [square], [square[::-1]], [[*square, square[0]]], [diamond], [diamond[::-1]],
        [[(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]],
        [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]], [[(0.0, 0.0), (3.0, 0.0)]], [[(0.0, 0.0), (3.0, 3.0)]],
        [[(1.0, 0.0), (2.0, 0.0), (3.0, 1.0), (3.0, 2.0), (2.0, 3.0), (1.0, 3.0), (0.0, 2.0), (0.0, 1.0)]],
    ]
    no = [
        [[(-2.0, 0.0), (0.0, -1.0), (2.0, 0.0), (0.0, 1.0)]], [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.001), (0.0, 4.0)]],
        [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0), (0.0, 2.0)]],
        [[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]], [square, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]],
        [square, [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]], [[(0.0, 0.0), (2.0, 0.0)], [(5.0, 0.0), (7.0, 0.0)]], [[(1.0, 1.0)]], [[]], [],
        [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 6.0), (4.0, 4.0), (0.0, 4.0)]], [[(0.0, 0.0), (4.0, None), (4.0, 4.0), (0.0, 4.0)]],
        [[*square, *square]],
    ]
    got = polygons_of(spark, yes + no).select("name", octagons.is_octagon(F.col("edges")).alias("o")).collect()
    assert {r["name"]: r["o"] for r in got} == {k: k < len(yes) for k in range(len(yes) + len(no))}


def shape(rng):
    """A box, diamond, half box, octagon, hook or flat diamond on whole numbers."""
    x, y, r, kind = rng.randint(-12, 12), rng.randint(-12, 12), rng.randint(1, 3), rng.randint(0, 5)
    corners = [
        [(0, 0), (r, 0), (r, 2), (0, 2)],
        [(-r, 0), (0, -r), (r, 0), (0, r)],
        [(0, 0), (r, 0), (0, r)],
        [(1, 0), (2, 0), (3, 1), (3, 2), (2, 3), (1, 3), (0, 2), (0, 1)],
        [(0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2)],
        [(-2 * r, 0), (0, -r), (2 * r, 0), (0, r)],
    ][kind]
    return [[(float(x + a), float(y + b)) for a, b in corners]]


@pytest.mark.parametrize(("crowd", "named"), [(4096, 1), (5, 1), (4096, 3)])
def test_octagons_meet_as_their_outlines_do(spark, monkeypatch, crowd, named):
    """Against the edges of all pairs; also in small blocks, and for names of several parts."""
    monkeypatch.setattr(octagons, "CROWD", crowd)
    rng = random.Random(crowd + named)
    cells = polygons_of(spark, [shape(rng) for _ in range(120)]).withColumn("key", F.col("name") % 2)
    cells = cells.withColumn("name", F.floor(F.col("name") / (2 * named)).cast("string"))
    pairs = spatial.meeting_pairs(cells, "key", "name", 4.0).collect()
    got = {(r["key"], *sorted((r["src"], r["dst"]))) for r in pairs}
    assert len(pairs) == len(got) and all(r["src"] != r["dst"] for r in pairs)
    monkeypatch.setattr(clipped, "is_octagon", lambda edges: F.lit(False))
    want = {(r["key"], *sorted((r["src"], r["dst"]))) for r in spatial.meeting_pairs(cells, "key", "name", 4.0).collect()}
    assert len(want) > 100
    assert got == want


def test_pairs_of_octagons_need_no_edges_and_no_shuffle(spark):
    """The plan compares numbers and ends with the join; edges and pairs moved before."""
    rows = [(k, k % 2, float(k * 37 % 101) / 2, float(k * 53 % 103) / 2, 2.0 + k % 5) for k in range(400)]
    corners = [(-1, 0), (0, -1), (1, 0), (0, 1)]
    shapes = [(k, key, [[(x + a * r, y + b * r) for a, b in corners]]) for k, key, x, y, r in rows]
    cells = spatial.polygon_table(spark.createDataFrame(shapes, f"cell_id int, country_id int, rings {RINGS}"))
    pairs = spatial.cell_neighbours(cells)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "Aggregate [src" not in plan and "Aggregate [country_id" not in plan.split("Join Inner")[0]
    got = [(r["country_id"], r["src"], r["dst"]) for r in pairs.collect()]
    want = {(p[1], p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and p[0] != q[0] and abs(p[2] - q[2]) + abs(p[3] - q[3]) <= p[4] + q[4]}
    assert len(got) == len(want) and set(got) == want


def test_octagons_far_from_other_outlines_are_not_clipped(spark, monkeypatch):
    """One hook among boxes: only what shares a square with it is cut."""
    boxes = [[[(x + a, y + b) for a, b in ((0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0))]] for x in range(0, 100, 5) for y in range(0, 50, 5)]
    hook = [[(11.0, 11.0), (13.0, 11.0), (13.0, 13.0), (12.0, 13.0), (12.0, 12.0), (11.0, 12.0)]]
    cells = polygons_of(spark, [*boxes, hook]).withColumn("key", F.lit(1))
    seen, clip = [], clipped.clip
    monkeypatch.setattr(clipped, "clip", lambda df, *a, **k: seen.append(df.count()) or clip(df, *a, **k))
    got = {tuple(sorted((r["src"], r["dst"]))) for r in spatial.meeting_pairs(cells, "key", "name", 4.0).collect()}
    assert len(seen) == 1 and 2 <= seen[0] < 30
    assert {p for p in got if p[1] == len(boxes)} == {(22, len(boxes))}
    assert len(got) == 19 * 10 + 20 * 9 + 2 * 19 * 9 + 1
