"""The steps of the geocell build on small tables."""

from pyspark.sql import functions as F

from geolens.operators import build, geocells


def clump(start, n, lat, lon, step=0.01):
    return [(start + i, lat + step * (i % 5), lon + step * (i // 5)) for i in range(n)]


def test_two_radii_and_hierarchical_ids(spark):
    """One crowded cell: its large cluster falls into two when looked at closely, its small one stays."""
    rows = [(p, 1, a, b) for p, a, b in clump(0, 20, 0.0, 0.0) + clump(100, 20, 0.4, 0.4) + clump(200, 6, 5.0, 5.0)]
    rows += [(900, 1, 9.0, 9.0)] + [(p, 2, a, b) for p, a, b in clump(300, 4, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "point_id long, cell_id long, lat double, lon double")
    got = build.clustered_cells(points, eps=0.6, tight_eps=0.05, max_points=30, min_cluster=10)
    ways = got.groupBy("parent_id", "parent_cluster", "cell_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("p")).collect()
    assert sorted((r["parent_id"], r["parent_cluster"], r["cell_id"], r["cluster_id"], r["n"], r["p"]) for r in ways) == [
        ("1", -1, "1", -1, 1, 900),
        ("1", 0, "1_0", 0, 20, 0),
        ("1", 0, "1_0", 1, 20, 100),
        ("1", 1, "1", 1, 6, 200),
        ("2", -1, "2", -1, 4, 300),
    ]
    named = got.withColumns({"country": F.lit("c"), "admin1": F.lit("a")})
    shapes = spark.createDataFrame([(1, 50.0, 60.0), (2, 70.0, 80.0)], "cell_id long, lat double, lon double")
    table = build.geocell_prototypes(named, shapes).collect()
    assert {(r["cell_id"], r["cluster_id"]): (r["count"], len(r["indices"]), r["indices"] == sorted(r["indices"])) for r in table} == {
        ("1", -1): (1, 1, True), ("1", 1): (6, 6, True), ("1_0", 0): (20, 20, True), ("1_0", 1): (20, 20, True), ("2", -1): (4, 4, True),
    }
    places = {r["cell_id"]: (r["geocell_index"], r["centroid_lat"]) for r in table}
    assert places["1"] == (0, 50.0) and places["2"] == (2, 70.0)
    mean = got.where("cell_id = '1_0'").agg(F.avg("lat")).first()[0]
    assert places["1_0"][0] == 1 and abs(places["1_0"][1] - mean) < 1e-9


def test_chunked_members_are_closed_up_to_a_bound(spark):
    rows = [(p, "c", "a", 1, p % 2, 0.0, 0.0) for p in range(25)] + [(100 + p, "c", "a", 1, 7, 0.0, 0.0) for p in range(12)]
    clustered = spark.createDataFrame(rows, "point_id long, country string, admin1 string, cell_id long, cluster_id long, lat double, lon double")
    members = geocells.prototype_members(clustered, chunk=4)
    closed = {(r["cluster_id"], r["chunk"]): r["indices"] for r in build.closed_members(members, at_once=12).collect()}
    assert closed[0, 0] == [0, 2, 4, 6] and closed[0, 3] == [24] and len(closed) == 4 + 2
    assert closed[1, 0] == list(range(1, 25, 2)) and closed[7, 0] == list(range(100, 112))


def test_merged_shapes_are_weighted_by_area(spark):
    from geolens.functions.geometry import box_ring
    from geolens.operators import spatial

    boxes = spark.createDataFrame(
        [(1, 1, 1, 0.0, 0.0, 2.0, 2.0), (2, 1, 1, 2.0, 0.0, 6.0, 2.0), (3, 1, 2, 6.0, 0.0, 8.0, 2.0)],
        "cell_id long, country_id long, admin1_id long, a double, b double, c double, d double",
    ).withColumn("rings", F.array(box_ring(F.col("a"), F.col("b"), F.col("c"), F.col("d"))))
    adm2 = spatial.polygon_table(build.with_shape(boxes.drop("a", "b", "c", "d")))
    whole = lambda *keys: spatial.polygon_table(
        boxes.groupBy(*keys).agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("c").alias("c"), F.max("d").alias("d"))
        .withColumn("rings", F.array(box_ring(F.col("a"), F.col("b"), F.col("c"), F.col("d")))).drop("a", "b", "c", "d")
    )
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 3.0), (3, 1.0, 4.0), (4, 1.0, 7.0), (5, 1.0, 7.5), (6, 50.0, 50.0)], "point_id long, lat double, lon double")
    moved, shapes = build.merged_cells(points, whole("country_id"), whole("country_id", "admin1_id"), adm2, min_points=2)
    cells = {r["point_id"]: r["cell_id"] for r in moved.collect()}
    assert cells == {1: 1, 2: 1, 3: 1, 4: 3, 5: 3}  # cell 1 absorbs its well filled neighbour, point 6 is in no region
    assert {r["cell_id"]: (round(r["lat"], 9), round(r["lon"], 9)) for r in shapes.collect()} == {1: (1.0, 3.0), 3: (1.0, 7.0)}
