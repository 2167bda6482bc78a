"""Hot keys, ordered numbering and partition independence."""

import random

import pytest
from pyspark.sql import functions as F

from geolens.operators import measures, tables
from geolens.operators.spread import global_index, rank_in_group, running_total, salted_join, top_per_key


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key."""
    rng = random.Random(7)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 40), rng.randrange(100)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, k long, v long").repartition(5)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, hot, how):
    _, frame = hot
    right = spark.createDataFrame([(k, f"r{k}-{c}") for k in range(0, 60, 2) for c in range(2)], "k long, name string")
    got = salted_join(frame, right, ["k"], how, rows_per_task=50)
    want = frame.join(right, "k", how)
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr) == sorted(
        map(tuple, want.select(*sorted(want.columns)).collect()), key=repr
    )


def test_salted_join_condition_keeps_unmatched_rows(spark, hot):
    rows, frame = hot
    right = spark.createDataFrame([(k, 50) for k in range(40)], "k long, bound long")
    got = salted_join(frame, right, ["k"], "left", condition=F.col("v") < F.col("bound"), rows_per_task=50)
    found = {r["id"]: r["bound"] for r in got.collect()}
    assert found == {i: (50 if v < 50 else None) for i, _, v in rows}


def test_global_index_is_the_sorted_position(hot):
    rows, frame = hot
    order = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    got = {r["id"]: r["row_index"] for r in global_index(frame, [F.col("v"), F.col("id")]).collect()}
    assert got == order


def test_running_total_over_a_hot_group(hot):
    rows, frame = hot
    want, sums = {}, {}
    for i, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    got = running_total(frame, ["k"], [F.col("id")], F.col("v"), "total")
    assert {r["id"]: r["total"] for r in got.collect()} == want


def test_rank_and_top_do_not_depend_on_partitions(hot):
    _, frame = hot
    results = []
    for n in (1, 7):
        part = frame.repartition(n)
        ranks = rank_in_group(part, ["k"], [F.col("v").desc(), F.col("id")])
        top = top_per_key(part, ["k"], [F.col("v"), F.col("id")], 3)
        results.append((sorted(map(tuple, ranks.collect())), sorted(map(tuple, top.collect()))))
    assert results[0] == results[1]


def test_null_groups_are_numbered_too(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(50)], "id long, k long")
    got = {r["id"]: r["rank"] for r in rank_in_group(frame, ["k"], [F.col("id")]).collect()}
    assert got == {i: i // 2 + 1 for i in range(50)}


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0, 5.0, 5.0, 1.0], [3.0, 1.0, 2.0], list(map(float, range(100)))])
def test_exact_median(spark, values):
    import statistics

    frame = spark.createDataFrame([("a", v) for v in values] + [("b", v + 1) for v in values * 3], "k string, v double")
    got = {r["k"]: r["median"] for r in measures.exact_median(frame, ["k"], "v").collect()}
    assert got == {"a": statistics.median(values), "b": statistics.median(v + 1 for v in values * 3)}
    assert measures.exact_median(frame.where("k = 'a'"), [], "v").first()[0] == statistics.median(values)


def test_split_sizes_and_singletons(spark):
    frame = spark.createDataFrame([(i, "big") for i in range(95)] + [(1000, "alone")], "id long, c string")
    train, val = tables.split_stratified(frame, "c", "id", 0.1)
    assert (train.count(), val.count()) == (86, 10)
    assert val.where("c = 'alone'").count() == 1
    first, rest = tables.split_ordered(frame, [F.col("id")], 0.9)
    assert first.count() == int(0.9 * 96) and first.agg(F.max("id")).first()[0] < rest.agg(F.min("id")).first()[0]


def test_allocation_loop(spark):
    areas = {"x": [5.0, 5.0, 5.0, 1.0], "flat": [0.0, 0.0], "one": [3.0]}
    rows = [(c, i, a) for c, list_ in areas.items() for i, a in enumerate(list_)]
    frame = spark.createDataFrame(rows, "country string, part_id long, area double")
    got = {(r["country"], r["part_id"]): r["take"] for r in tables.allocate_by_area(frame, 10, 1.5).collect()}
    want = {}
    for country, list_ in areas.items():
        total, taken = sum(list_), 0
        for i, area in enumerate(list_):
            if total:
                want[country, i] = min(round(area * 1.5 / total * 10), 10 - taken)
                taken += want[country, i]
    assert got == want


def test_merge_latest_wins_edges(spark):
    batch = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "y")], "location_id string, heading int, ord long, extra string")
    assert tables.merge_latest_wins(None, batch).count() == 2
    empty = batch.limit(0).drop("extra")
    assert tables.merge_latest_wins(empty, batch).count() == 2
    old = spark.createDataFrame([("a", 0, 9), ("b", 90, 9)], "location_id string, heading int, ord long")
    merged = {(r["location_id"], r["heading"]): r["extra"] for r in tables.merge_latest_wins(old, batch).collect()}
    assert merged == {("a", 0): "y", ("b", 90): None}


def test_panoramas_of_three_and_five_tiles(spark):
    rows = [("three", i) for i in range(3)] + [("five", i) for i in range(5)]
    frame = spark.createDataFrame(rows, "location_id string, ord long")
    got = sorted(map(tuple, tables.complete_panoramas(frame, "location_id", [F.col("ord")]).collect()))
    assert got == [("five", i, i + 1) for i in range(4)]


def test_label_map_gives_unseen_classes_their_own_number(spark):
    labels = tables.label_map(spark.createDataFrame([("b",), ("a",), ("b",)], "c string"), "c")
    out = tables.apply_label_map(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", labels)
    assert sorted((r["class_name"], r["label_id"]) for r in out.collect()) == [("UNKNOWN", 2), ("UNKNOWN", 2), ("a", 0)]


def test_version_out_of_range(spark):
    keys = spark.createDataFrame([("m/run_ts=1/x",), ("m/run_ts=2/x",), ("m/other",)], "key string")
    assert tables.version_nth(keys, 1).first()[0] == "1"
    with pytest.raises(IndexError):
        tables.version_nth(keys, 2)


def test_filter_countries_needs_a_name_column(spark):
    names = spark.createDataFrame([(" norway",)], "name string")
    frame = spark.createDataFrame([("Norway",), ("Peru",)], "ADMIN string")
    assert [r[0] for r in tables.filter_countries(frame, names).collect()] == ["Norway"]
    with pytest.raises(ValueError):
        tables.filter_countries(frame.withColumnRenamed("ADMIN", "place"), names)


def test_auc_and_accuracy_edges(spark):
    one_class = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    auc = measures.binary_auc(one_class, "y", "s").first()[0]
    assert auc != auc
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert measures.binary_auc(ties, "y", "s").first()[0] == pytest.approx(0.875)
    none = spark.createDataFrame([], "covered boolean")
    assert tuple(measures.conversion_rate(none, "covered", target=5).first()) == (0, 0, 0.0, None)
    assert tuple(measures.map_center(spark.createDataFrame([], "lat double, lon double")).first()) == (60.0, 15.0, 0)
    with pytest.raises(ValueError):
        measures.result_summary(spark.createDataFrame([], "distance_km double, top1_prob double, score double"))


def test_rows_without_stratum_or_country_are_kept(spark):
    frame = spark.createDataFrame([(i, "a" if i < 10 else None) for i in range(30)], "id long, c string")
    train, val = tables.split_stratified(frame, "c", "id", 0.1)
    assert train.unionByName(val).count() == 30 and val.count() == 3
    parts = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, None, 2.0)], "part_id long, country string, area double")
    got = {r["part_id"]: r["take"] for r in tables.allocate_by_area(parts, 10).collect()}
    assert got == {1: 10, 2: 5, 3: 5}


def test_picks_of_any_size_follow_the_order(spark):
    frame = spark.createDataFrame([(i * 7 % 50, i % 3) for i in range(50)] * 2, "id long, tie long").repartition(7)
    for n in (0, 1, 20, 99, 100, 5000):
        got = [r["id"] for r in tables.first_n(frame, [frame["id"].desc()], n).collect()]
        assert got == sorted([i % 50 for i in range(100)], reverse=True)[:n]
    assert tables.first_n(frame.limit(0), [F.col("id")], 3).count() == 0
