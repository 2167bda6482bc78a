"""Spatial joins against brute force on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.operators import grid, sampling, spatial


def haversine(a, b, radius):
    p, q = map(math.radians, (a[0], b[0]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius / 1000 * math.asin(math.sqrt(min(1, h)))


def polygons(spark, rows, schema):
    return spatial.polygon_table(spark.createDataFrame(rows, f"{schema}, rings array<array<struct<x:double,y:double>>>"))


def box(*sides):
    x0, y0, x1, y1 = map(float, sides)
    return [(x1, y1), (x0, y1), (x0, y0), (x1, y0), (x1, y1)]


def scatter(n, seed):
    """Points of which a third crowd into one small area, with copies."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((i, 10 + rng.randrange(6) * 0.01, 20 + rng.randrange(6) * 0.01))
        else:
            out.append((i, rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)))
    return out


def test_within_excludes_the_boundary_and_duplicates_overlaps(spark):
    cells = polygons(
        spark,
        [("a", [box(0, 0, 10, 10)]), ("b", [box(5, 5, 15, 15)]), ("holed", [box(20, 0, 30, 10), box(22, 2, 28, 8)])],
        "name string",
    )
    points = spark.createDataFrame(
        [(0, 1.0, 1.0), (1, 7.0, 7.0), (2, 0.0, 5.0), (3, 10.0, 10.0), (4, 5.0, 25.0), (5, 1.0, 21.0), (6, -50.0, 0.0)],
        "id long, lat double, lon double",
    )
    got = sorted((r["id"], r["name"]) for r in spatial.join_within(points, cells, "name").collect())
    assert got == [
        (0, "a"), (1, "a"), (1, "b"), (2, "UNKNOWN"), (3, "b"), (4, "UNKNOWN"), (5, "holed"), (6, "UNKNOWN"),
    ]


def test_covered_or_nearest(spark):
    cells = polygons(spark, [(3, [box(0, 0, 10, 10)]), (1, [box(10, 0, 20, 10)]), (2, [box(-100, -50, -99, -49)])], "geocell_index long")
    rows = [(0, 10.0, 10.0), (1, 5.0, 5.0), (2, 5.0, 31.0), (3, -60.0, -150.0), (4, 80.0, 170.0), (5, -20.0, 10.0)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    got = {r["id"]: (r["geocell_index"], list(r["one_hot"])) for r in spatial.label_covered_or_nearest(points, cells, 4).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 1, 1: 3, 2: 1, 3: 2, 4: 1, 5: 1}
    assert got[3][1] == [0, 0, 1, 0]


def test_bbox_label_defaults_to_zero(spark):
    cells = spark.createDataFrame(
        [(5, box(0, 0, 10, 10)), (4, box(10, 0, 20, 10))], "geocell_index int, ring array<struct<x:double,y:double>>"
    )
    points = spark.createDataFrame([(0, 5.0, 10.0), (1, 5.0, 1.0), (2, 50.0, 50.0)], "id long, lat double, lon double")
    got = {r["id"]: r["geocell_index"] for r in spatial.label_bbox(points, cells).collect()}
    assert got == {0: 4, 1: 5, 2: 0}


@pytest.mark.parametrize("centroids", [1, 60])
def test_nearest_centroid_everywhere_on_the_globe(spark, centroids):
    rng = random.Random(centroids)
    points = scatter(300, 1) + [(1000, 89.99, 5.0), (1001, -90.0, 0.0), (1002, 0.0, 180.0), (1003, 0.0, -180.0)]
    cells = [(c, rng.uniform(50, 60), rng.uniform(0, 15)) for c in range(centroids // 2)]
    cells += [(centroids // 2 + c, rng.uniform(-90, 90), rng.uniform(-180, 180)) for c in range(centroids - centroids // 2)]
    got = spatial.nearest_centroid(
        spark.createDataFrame(points, "id long, lat double, lon double"),
        spark.createDataFrame(cells, "geocell_index long, clat double, clon double"),
    ).collect()
    assert len(got) == len(points)
    for row in got:
        best = min(haversine((row["lat"], row["lon"]), (a, b), K.LABEL_RADIUS_M) for _, a, b in cells)
        assert row["distance_km"] == pytest.approx(best, abs=1e-5)


def test_lookup_with_items_far_from_the_points(spark):
    rng = random.Random(3)
    table = [(i, rng.uniform(50, 51), rng.uniform(100, 101)) for i in range(80)]
    points = scatter(150, 2) + [(900 + i, lat, lon) for i, lat, lon in table[:5]]
    got = spatial.lookup_exact_or_nearest(
        spark.createDataFrame(points, "id long, lat double, lon double"),
        spark.createDataFrame(table, "key long, lat double, lon double"),
        "key",
    ).collect()
    assert len(got) == len(points)
    for row in got:
        best = min(((row["lon"] - b) ** 2 + (row["lat"] - a) ** 2, k) for k, a, b in table)
        assert row["key"] == best[1] and row["exact"] == (best[0] == 0)


@pytest.mark.parametrize("radius", [60.0, 1000.0])
def test_coverage_snap(spark, radius):
    rng = random.Random(5)
    points = scatter(120, 4) + [(1, 0.0, 179.9999), (2, 89.9999, 0.0)]
    sites = [(a + rng.uniform(-0.01, 0.01), b + rng.uniform(-0.01, 0.01)) for _, a, b in points]
    sites += [(0.0, -179.9999), (89.9999, 180.0)] + sites[:10]
    sites = [(max(-90.0, min(90.0, a)), b) for a, b in sites]
    got = spatial.coverage_snap(
        spark.createDataFrame(points, "id long, lat double, lon double"),
        spark.createDataFrame(sites, "lat double, lon double"),
        radius,
    )
    want = set()
    for _, a, b in points:
        near = [(haversine((a, b), s, K.SCORE_RADIUS_M), s) for s in sites]
        if min(near)[0] <= radius / 1000:
            want.add(tuple(round(v, 6) for v in min(near)[1]))
    assert {tuple(r) for r in got.collect()} == want and want


def test_neighbours_touching_containing_and_apart(spark):
    shapes = {
        1: [box(0, 0, 1, 1)],
        2: [box(1, 1, 2, 2)],
        3: [box(0.2, 0.2, 0.4, 0.4)],
        4: [box(5, 5, 30, 30)],
        5: [box(30, 0, 31, 40)],
        6: [[(0.0, 3.0), (3.0, 6.0), (3.0, 7.0), (0.0, 3.0)]],
        7: [[(1.0, 3.0), (3.0, 5.0), (3.0, 3.0), (1.0, 3.0)]],
    }
    cells = polygons(spark, [(k, 1, v) for k, v in shapes.items()] + [(99, 2, [box(0, 0, 9, 9)])], "cell_id long, country_id long")
    got = {(r["src"], r["dst"]) for r in spatial.cell_neighbours(cells).collect()}
    assert got == {(1, 2), (2, 1), (1, 3), (3, 1), (4, 5), (5, 4)}


def test_admin_levels_are_nested(spark):
    adm0 = polygons(spark, [(1, [box(0, 0, 10, 10)]), (2, [box(10, 0, 20, 10)])], "country_id long")
    adm1 = polygons(spark, [(1, 1, [box(0, 0, 5, 10)]), (2, 1, [box(5, 0, 20, 10)])], "country_id long, admin1_id long")
    adm2 = polygons(
        spark,
        [(1, 1, 7, [box(0, 0, 5, 5)]), (1, 1, 6, [box(0, 0, 5, 10)]), (2, 1, 5, [box(10, 0, 20, 10)])],
        "country_id long, admin1_id long, cell_id long",
    )
    points = spark.createDataFrame(
        [(0, 1.0, 1.0), (1, 1.0, 7.0), (2, 2.0, 12.0), (3, 2.0, 10.0), (4, 50.0, 1.0)], "id long, lat double, lon double"
    )
    got = {r["id"]: r["cell_id"] for r in spatial.assign_admin_cell(points, adm0, adm1, adm2).collect()}
    assert got == {0: 6, 2: 5}


def test_sampling_counts_positions_and_repartitioning(spark):
    thin = [(0.0, 0.0), (10.0, 0.0), (10.0, 0.2), (0.1, 0.1), (0.0, 10.0), (0.0, 0.0)]
    parts = spark.createDataFrame(
        [("x", 1, 9.0, [thin]), ("x", 2, 1.0, [box(20, 20, 21, 21)]), ("flat", 3, 0.0, [box(0, 0, 0, 0)])],
        "country string, part_id long, area double, rings array<array<struct<x:double,y:double>>>",
    )
    table = spatial.polygon_table(parts)
    runs = []
    for n in (1, 7):
        got = sampling.sample_in_polygons(table.repartition(n), 50)
        runs.append(sorted(map(tuple, got.select("part_id", "trial", "lat", "lon").collect())))
    assert runs[0] == runs[1]
    counts = [sum(r[0] == p for r in runs[0]) for p in (1, 2, 3)]
    assert counts == [45, 5, 0]
    assert all(20 < r[2] < 21 and 20 < r[3] < 21 for r in runs[0] if r[0] == 2)
    assert all(r[2] < 0.2 or r[3] < 0.2 for r in runs[0] if r[0] == 1)
    assert len({r[2:] for r in runs[0]}) == 50


def test_points_without_coordinates_keep_their_row(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 1.0, None)], "point_id long, lat double, lon double")
    cells = spark.createDataFrame([(7, 1.0, 1.0)], "geocell_index long, clat double, clon double")
    got = {r["point_id"]: r["geocell_index"] for r in spatial.nearest_centroid(points, cells).collect()}
    assert got == {1: 7, 2: None, 3: None}
    table = spark.createDataFrame([(5, 0.0, 0.0)], "id long, lat double, lon double")
    got = {r["point_id"]: (r["id"], r["exact"]) for r in spatial.lookup_exact_or_nearest(points, table, "id").collect()}
    assert got == {1: (5, True), 2: (None, None), 3: (None, None)}


def test_cells_with_several_parts_are_neighbours(spark):
    """The second part of cell 2 lies inside cell 1; its first part is far away."""
    square_ = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]
    shapes = {1: [square_(0.0, 0.0, 10.0)], 2: [square_(50.0, 50.0, 1.0), square_(4.0, 4.0, 1.0)], 3: [square_(-40.0, -40.0, 1.0)]}
    rows = []
    for cell, rings in shapes.items():
        edges = [(x1, y1, x2, y2) for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:])]
        xs, ys = [e[0] for e in edges], [e[1] for e in edges]
        rows.append((cell, 1, edges, min(xs), min(ys), max(xs), max(ys)))
    schema = "cell_id long, country_id long, edges array<struct<x1: double, y1: double, x2: double, y2: double>>, min_x double, min_y double, max_x double, max_y double"
    pairs = {(r["src"], r["dst"]) for r in spatial.cell_neighbours(spark.createDataFrame(rows, schema)).collect()}
    assert pairs == {(1, 2), (2, 1)}


def test_slivers_get_all_their_points(spark):
    """A triangle that fills a millionth of its box, a diagonal band with a hole, and two far parts of one shape."""
    ring = lambda *p: [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(p, (*p[1:], p[0]))]
    shapes = {
        1: ring((0.0, 0.0), (10.0, 10.0), (10.0, 10.00001)),
        2: ring((0.0, 0.0), (100.0, 99.9), (100.0, 100.0), (0.0, 0.1)) + ring((50.0, 50.0), (50.01, 50.02), (50.01, 50.03)),
        3: ring((0.0, 0.0), (0.001, 0.0), (0.0, 0.001)) + ring((90.0, 90.0), (90.001, 90.0), (90.0, 90.003)),
    }
    rows = [(k, "c", 1.0, e, min(min(a[0], a[2]) for a in e), min(min(a[1], a[3]) for a in e), max(max(a[0], a[2]) for a in e), max(max(a[1], a[3]) for a in e)) for k, e in shapes.items()]
    schema = "part_id long, country string, area double, edges array<struct<x1: double, y1: double, x2: double, y2: double>>, min_x double, min_y double, max_x double, max_y double"
    parts = spark.createDataFrame(rows, schema)
    got = sampling.sample_in_polygons(parts, 600).collect()
    assert sorted(r["part_id"] for r in got) == [1] * 200 + [2] * 200 + [3] * 200
    assert sorted(map(tuple, sampling.sample_in_polygons(parts.repartition(3), 600).collect())) == sorted(map(tuple, got))
    for r in got:
        x, y = r["lon"], r["lat"]
        if r["part_id"] == 1:
            assert x - 1e-12 <= y <= x * 1.000001 + 1e-12
        elif r["part_id"] == 2:
            assert 0.999 * x - 1e-9 <= y <= 0.999 * x + 0.1 + 1e-9
    upper = sum(r["lat"] > 45 for r in got if r["part_id"] == 3)
    assert 120 < upper < 180  # three quarters of the area


def test_sampling_run_draws_until_enough_is_covered(spark):
    """Land a is covered on a fine grid, land b nowhere, land c in one place only; the part without a land is small."""
    shapes = [("a", 0, box(0, 0, 1, 1)), ("a", 1, box(3, 0, 4, 2)), ("b", 0, box(20, 0, 21, 1)), ("c", 0, box(40, 0, 40.1, 0.1)), (None, 0, box(60, 0, 60.2, 0.2))]
    shapes += [shapes[0], ("flat", 0, box(9, 9, 9, 9))]
    area = lambda ring: (ring[2][0] - ring[0][0]) * (ring[2][1] - ring[0][1])
    rows = [(land, "n", None, k, [ring], abs(area(ring))) for land, k, ring in shapes]
    schema = "country string, name_1 string, name_2 string, part_id int, rings array<array<struct<x: double, y: double>>>, area double"
    parts = sampling.boundary_parts(spark.createDataFrame(rows, schema))
    assert sorted(r["part_id"] for r in parts.collect()) == [0, 1, 2, 3, 4]
    sites = [(i / 20, j / 20) for i in range(41) for j in range(81)] + [(0.05, 40.05)] + [(i / 50, 60 + j / 50) for i in range(11) for j in range(11)] + [(None, 1.0)]
    sites = spark.createDataFrame(sites, "lat double, lon double")
    run = sampling.sampling_run(parts, sites, 12, radius_m=2000.0, limit=100)
    report = {r["country"]: r for r in run.report.collect()}
    assert set(report) == {"a", "b", "c", None}
    points, drawn = run.points.collect(), run.candidates.collect()
    for land, r in report.items():
        own = [(p["lat"], p["lon"]) for p in points if p["country"] == land]
        assert len(own) == len(set(own)) == r["covered"]
        mine = [(d["lat"], d["lon"]) for d in drawn if d["country"] == land]
        assert len(mine) == len(set(mine)) == r["candidates"] and r["candidates"] <= r["asked"] <= 100
        near = {min((haversine(d, s, K.SCORE_RADIUS_M), s) for s in [tuple(x) for x in sites.dropna().collect()]) for d in mine}
        assert set(own) == {tuple(round(v, 6) for v in s) for km, s in near if km <= 2.0}
    assert report["a"]["covered"] >= 12 and report["a"]["rounds"] > 1 and report[None]["covered"] >= 12
    assert (report["b"]["covered"], report["b"]["asked"], report["b"]["needed"]) == (0, 100, None)
    assert (report["c"]["covered"], report["c"]["asked"]) == (1, 100)
    none = sampling.sampling_run(parts.limit(0), sites, 5)
    assert none.points.count() == none.candidates.count() == none.report.count() == 0


def diamond(x, y, rx, ry):
    return [(x - rx, y), (x, y - ry), (x + rx, y), (x, y + ry), (x - rx, y)]


def milli(point_id):
    return (point_id * 7919 % 170001 - 85000) / 1000.0, (point_id * 104729 % 360000 - 180000) / 1000.0


def test_decimals_on_a_slanted_edge_are_outside(spark):
    """Thousandths that lie on the outline exactly, though their doubles may be a rounding inside."""
    cells = polygons(spark, [(c, [diamond(c % 5 * 72 - 144.0, c // 5 * 36 - 72.0, 36.0, 18.0)]) for c in range(25)], "name long")
    ids = [53734, 73696, 151726, 229756, 307786, 639868]
    rows = [(k, *milli(k)) for k in ids]
    rows += [(-i, -72.0 + i * 0.001, -144.0 + 36.0 - i * 0.002) for i in range(1, 18000, 37)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    got = spatial.join_within(points, cells.withColumn("name", F.col("name").cast("string")), "name").collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    assert {r["name"] for r in got} == {"UNKNOWN"}


def test_diamonds_that_touch_are_neighbours(spark):
    """Pairs whose distance in the sum norm is the sum of their radii in thousandths, and as many just beyond."""
    rows, want = [], set()
    for number, k in enumerate(k for k in range(1, 20000, 7) if touching(k, k + 562792)):
        for name, step in ((k, 0.0), (-k, 0.001)):
            for j in (k, k + 562792):
                lat, lon = milli(j)
                away = step if j > k else 0.0
                lat += math.copysign(away, lat - milli(k)[0])
                lat = round(lat, 3)
                rows.append((2 * name + (j > k), number * 2 + (name < 0), [diamond(lon, lat, 2.0 + j % 5, 2.0 + j % 5)]))
        want |= {(2 * k, 2 * k + 1), (2 * k + 1, 2 * k)}
    cells = polygons(spark, rows, "cell_id long, country_id long")
    got = spatial.cell_neighbours(cells, size=4.0).collect()
    assert len(want) > 200
    assert {(r["src"], r["dst"]) for r in got} == want


def touching(a, b):
    (ya, xa), (yb, xb) = milli(a), milli(b)
    return round(1000 * abs(xa - xb)) + round(1000 * abs(ya - yb)) == 1000 * (4 + a % 5 + b % 5)


def test_nearest_search_broadcasts_no_exploded_items(spark):
    """Items are repeated on every level, of which Spark's size estimates know nothing."""
    from geolens.operators.grid import nearest_candidates

    queries = spark.range(50).select(F.rand(1).alias("q0"), F.rand(2).alias("q1"))
    items = spark.range(50).select(F.rand(3).alias("i0"), F.rand(4).alias("i1"), "id")
    seen, keep = [], grid.cut_lineage
    try:
        grid.cut_lineage = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()) or keep(df)
        nearest_candidates(queries, items, 2, 0.5, 3)
    finally:
        grid.cut_lineage = keep
    assert "SortMergeJoin [lv" in seen[0] and "BroadcastHashJoin [lv" not in seen[0]
