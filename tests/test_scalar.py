import hashlib
import math
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions import geometry as G
from geolens.functions import scalar as S
from geolens.functions.sql import register_functions
from geolens.plans.catalog import all_queries
from geolens.session import range_tasks


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_location_id_matches_packed_integers(spark):
    points = [(59.9, 10.7), (-33.8567844, 151.2152967), (0.0, -0.0), (-90.0, -180.0), (90.0, 180.0)]
    frame = spark.createDataFrame(points, "lat double, lon double")
    got = [r[0] for r in frame.select(S.location_id(F.col("lat"), F.col("lon"))).collect()]
    want = [
        hashlib.sha1(b"geo:v1:" + struct.pack(">ii", int(round(a * 10**7)), int(round(b * 10**7)))).hexdigest()[:12]
        for a, b in points
    ]
    assert got == want


def test_location_id_out_of_bounds(spark):
    for lat, lon in [(90.01, 0.0), (0.0, -180.5), (float("nan"), 0.0)]:
        with pytest.raises(PySparkException):
            one(spark, S.location_id(F.lit(lat), F.lit(lon)))


def test_haversine_antimeridian_poles_antipodes(spark):
    row = one(
        spark,
        S.haversine_km(F.lit(0.0), F.lit(179.5), F.lit(0.0), F.lit(-179.5)),
        S.haversine_km(F.lit(90.0), F.lit(0.0), F.lit(90.0), F.lit(123.0)),
        S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
        S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0), K.LABEL_RADIUS_M),
    )
    assert row[0] == pytest.approx(math.pi / 180 * 6371, abs=1e-9)
    assert row[1] == pytest.approx(0.0, abs=1e-9)
    assert row[2] == pytest.approx(math.pi * 6371.0)
    assert row[3] == pytest.approx(math.pi * 6378.137)


def test_game_score_edges(spark):
    half = -1492.7 * math.log(0.5 / 5000.0)  # 0.5 exactly in between: half-even gives 0
    row = one(spark, *[S.game_score(F.lit(float(d))) for d in (-3, 0, 20000, half)])
    assert list(row)[:3] == [5000, 5000, 0]
    assert row[3] in (0, 1)


@pytest.mark.parametrize("method", ["closed", "iterated"])
def test_ecef_round_trip_including_poles(spark, method):
    points = [(0.0, 0.0), (90.0, 0.0), (-90.0, 0.0), (45.0, 180.0), (-60.5, -179.9), (0.001, 90.0), (89.999, 10.0)]
    frame = spark.createDataFrame(points, "lat double, lon double")
    e = S.ecef_from_lla(F.col("lat"), F.col("lon"))
    back = frame.select("lat", "lon", e.alias("e")).select(
        "lat", "lon", S.lla_from_ecef(F.col("e.x"), F.col("e.y"), F.col("e.z"), method).alias("b")
    )
    for row in back.collect():
        assert row["b"]["lat"] == pytest.approx(row["lat"], abs=1e-7)
        if abs(row["lat"]) < 90:
            assert math.cos(math.radians(row["b"]["lon"] - row["lon"])) == pytest.approx(1.0)


def test_headings(spark):
    row = one(spark, S.heading_distance(F.lit(350), F.lit(10)), S.heading_distance(F.lit(0), F.lit(180)))
    assert list(row) == [20, 180]
    views = one(spark, S.heading_features(F.lit(30.0)))[0]
    assert views[1][0] == pytest.approx(math.sin(math.radians(120)))
    assert views[3][1] == pytest.approx(math.cos(math.radians(300)))


def test_months_countries_and_validity(spark):
    null = F.lit(None).cast("string")
    row = one(
        spark,
        S.month_features(F.lit("2024-03-05"), null),
        S.month_features(null, F.lit("2019-12")),
        S.month_features(null, F.lit("2019-77")),
        S.month_features(null, null),
        S.drive_right(null),
        S.drive_right(F.lit("Japan")),
        S.drive_right(F.lit("Norway")),
        S.country_display(F.lit("United States Of America")),
        S.is_valid(F.lit(" \t\n")),
        S.is_valid(null),
        S.is_valid(F.lit(float("nan")), floating=True),
    )
    assert list(row) == [
        "March", "December", "77", None, False, False, True, "the United States", False, False, False,
    ]


def test_round6_is_half_even(spark):
    assert list(one(spark, S.round6(F.lit(0.0000005)), S.round6(F.lit(0.0000015)))) == [0.0, 2e-06]


def test_caption_gates_and_fallbacks(spark):
    rows = [(i, "Norway", "Viken", None, "A Polar Tundra climate", True, "May", "2020-01", 1.5, 2.25) for i in range(2000)]
    rows += [(5000, None, "x", "y", None, None, None, None, 1.5, 2.25), (5001, None, None, None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(
        rows,
        "location_id long, country string, region string, town string, climate string, drive_right boolean, "
        "month string, capture_date string, lat double, lon double",
    )
    text = {r[0]: r[1] for r in S.caption(frame).select("location_id", "caption").collect()}
    assert text[5000] == "A Street View photo taken around latitude 1.500, longitude 2.250."
    assert text[5001] == "A Street View photo."
    some = [text[i] for i in range(2000)]
    share = lambda part: sum(part in s for s in some) / 2000
    assert share("in the region of Viken ") == pytest.approx(0.6, abs=0.04)
    assert share("has a polar tundra climate.") == pytest.approx(0.4, abs=0.04)
    assert share("right side of the road") == pytest.approx(0.6 * 0.3, abs=0.03)
    assert share("taken in May.") == pytest.approx(0.3, abs=0.04)
    assert share("taken in January.") == pytest.approx(0.7 * 0.3, abs=0.04)
    assert not any("climate" in s and "side of the road" in s for s in some)
    again = S.caption(frame.repartition(7)).select("location_id", "caption").collect()
    assert {r[0]: r[1] for r in again} == text
    optional = [r[0] for r in S.caption(frame, location_optional=True).select("caption").collect()]
    assert any(s.startswith("This location has") for s in optional)


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_polygon_boundary_vertex_and_hole(spark):
    outer, hole = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (3, 1), (3, 3), (1, 3))
    edges = G.polygon_edges(F.array(outer, hole))

    def tests(x, y):
        point = (F.lit(float(x)), F.lit(float(y)))
        return list(one(spark, G.contains_point(edges, *point), G.covers_point(edges, *point)))

    assert tests(0.5, 0.5) == [True, True]
    assert tests(2, 2) == [False, False]
    assert tests(0, 2) == [False, True]
    assert tests(4, 4) == [False, True]
    assert tests(1, 2) == [False, True]
    assert tests(5, 1) == [False, False]
    assert tests(-1, 0) == [False, False]


def test_ring_measures_and_wkt(spark):
    row = one(spark, G.ring_area(ring((0, 0), (3, 0), (0, 3))), G.ring_centroid(ring((0, 0), (3, 0), (0, 3))))
    assert row[0] == 4.5 and row[1]["x"] == pytest.approx(1.0)
    flat = one(spark, G.ring_centroid(ring((0, 0), (2, 2), (4, 4))))[0]
    assert flat["x"] == pytest.approx(2.0)
    rings = one(spark, G.polygon_from_wkt(F.lit("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))")))[0]
    assert [len(r) for r in rings] == [4, 4, 4] and rings[2][1]["x"] == 5.2


def test_text_of_polygons_is_parsed_in_many_tasks(spark):
    found = all_queries()["polygon_from_wkt"](spark, "/root/testdata/sf0.01")
    assert found.rdd.getNumPartitions() == range_tasks(spark) > 1


def test_vectors_and_one_hot(spark):
    a, b = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))
    assert list(one(spark, S.euclidean(a, b), S.cosine(a, b), S.one_hot(F.lit(2), 4))) == [5.0, 0.0, [0, 0, 1, 0]]


def test_sql_functions_agree_with_columns(spark):
    register_functions(spark, "t_")
    got = spark.sql(
        "SELECT t_location_id(59.9D, 10.7D), t_game_score(100D), t_heading_distance(350D, 10D), t_month_name('2020-13'), "
        "t_drive_right(NULL), t_country_display('Maldives'), t_is_valid('  '), t_round6(0.0000015D), t_one_hot(1, 3), "
        "t_euclidean(array(3D, 0D), array(0D, 4D)), t_image_key('ab', 90)"
    ).first()
    want = one(
        spark,
        S.location_id(F.lit(59.9), F.lit(10.7)), S.game_score(F.lit(100.0)), S.heading_distance(F.lit(350.0), F.lit(10.0)),
        S.month_name(F.lit("2020-13")), F.lit(False), F.lit("the Maldives"), F.lit(False), S.round6(F.lit(0.0000015)),
        S.one_hot(F.lit(1), 3), F.lit(5.0), S.image_key(F.lit("ab"), F.lit(90)),
    )
    assert list(got) == list(want)


def test_sql_functions_say_what_the_columns_say(spark):
    from geolens.functions import geometry as G
    from geolens.functions.sql import register_functions

    register_functions(spark, "same_")
    places = [(0.0, 0.0), (90.0, 5.0), (-90.0, 0.0), (59.9, 10.7), (-33.9, 151.2), (1e-9, -180.0), (45.0, 90.0)]
    table = spark.createDataFrame(places, "lat double, lon double").withColumn("p", S.ecef_from_lla("lat", "lon"))
    table = table.withColumn("back", S.lla_from_ecef(F.col("p.x"), F.col("p.y"), F.col("p.z")))
    for r in table.selectExpr("p", "back", "same_ecef_from_lla(lat, lon) AS q", "same_lla_from_ecef(p.x, p.y, p.z) AS again").collect():
        assert tuple(r["q"]) == pytest.approx(tuple(r["p"]), abs=1e-6)
        assert tuple(r["again"]) == pytest.approx(tuple(r["back"]), abs=1e-9)
    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]
    table = spark.createDataFrame([(r,) for r in rings], "ring array<struct<x: double, y: double>>")
    table = table.select("ring", G.ring_bbox(F.col("ring")).alias("b"), G.ring_centroid(F.col("ring")).alias("c"))
    for r in table.selectExpr("b", "c", "same_ring_bbox(ring) AS b2", "same_ring_centroid(ring) AS c2").collect():
        assert r["b"] == r["b2"] and tuple(r["c2"]) == pytest.approx(tuple(r["c"]))
    values = spark.createDataFrame([(None,), ("",), ("\t\n",), (" ",), (" x",)], "v string")
    assert values.where(S.is_valid(F.col("v")) != F.expr("same_is_valid(v)")).count() == 0
    assert spark.sql("SELECT same_multitask_labels(1, 2, 3, 4, 5, NULL) AS l").first()["l"] == [1.0, 2.0, 3.0, 4.0, 5.0, None]
