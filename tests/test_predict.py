"""Predictions, refinement and losses on hand-made inputs."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.operators import measures, predict, tables


def vectors(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def head(spark):
    rng = np.random.default_rng(0)
    weights = [(i, [float(v) for v in rng.normal(size=4)], float(rng.normal())) for i in range(11)]
    samples = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(40)]
    return (
        spark.createDataFrame(samples, "sample_id long, embedding array<float>"),
        spark.createDataFrame(weights, "geocell_index long, weight array<double>, bias double"),
        spark.createDataFrame([(i, float(i), -float(i)) for i in range(11)], "geocell_index long, clat double, clon double"),
    )


def test_class_slices_do_not_change_the_result(head, monkeypatch):
    def run():
        out = predict.score_linear_head(*head, dim=4, k=5).collect()
        return {
            r["sample_id"]: (r["geocell_index"], r["pred_lat"], [(c[0], round(c[1], 10)) for c in r["candidates"]]) for r in out
        }

    whole = run()
    monkeypatch.setattr(predict, "BLOCK_BYTES", 8 * 6 * 3)
    assert run() == whole
    logits = predict.class_logits(head[0], head[1], 4)
    assert logits.count() == 40 * 11


def test_head_matches_numpy(head):
    samples, weights, cells = (f.toPandas() for f in head)
    x = np.stack(samples["embedding"]).astype(np.float64)
    logits = x @ np.stack(weights["weight"]).T + weights["bias"].to_numpy()
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    for row in predict.score_linear_head(*head, dim=4, k=3).collect():
        order = np.argsort(-p[row["sample_id"]])[:3]
        assert [c["geocell_index"] for c in row["candidates"]] == list(order)
        assert [c["probability"] for c in row["candidates"]] == pytest.approx(list(p[row["sample_id"]][order]))


def protos(spark):
    return spark.createDataFrame(
        [(1, 0, [0.0, 0.0], 10.0, 10.0), (1, 1, [5.0, 0.0], 11.0, 11.0), (2, 0, [1.0, 0.0], 10.5, 10.5), (3, 0, [0.1, 0.0], 60.0, 60.0)],
        "geocell_index long, cluster_id long, embedding array<double>, centroid_lat double, centroid_lon double",
    )


def members(spark):
    return spark.createDataFrame(
        [(1, 0, 7, [0.2, 0.0], 10.1, 10.1), (1, 0, 8, [0.9, 0.0], 10.2, 10.2), (1, 0, 9, [0.2, 0.0], 10.3, 10.3)],
        "geocell_index long, cluster_id long, point_idx long, embedding array<double>, lat double, lon double",
    )


def test_missing_prototypes_and_member_pick(spark):
    samples = spark.createDataFrame([(1, [0.0, 0.0])], "sample_id long, embedding array<double>")
    candidates = spark.createDataFrame([(1, 0, 1, 0.6), (1, 1, 99, 0.4)], "sample_id long, candidate int, geocell_index long, probability double")
    near = predict.nearest_prototype(samples, candidates, protos(spark))
    rows = {r["candidate"]: r for r in near.collect()}
    assert (rows[0]["cluster_id"], rows[0]["logit"]) == (0, 0.0)
    assert (rows[1]["cluster_id"], rows[1]["logit"], rows[1]["centroid_lat"]) == (None, K.MISSING_LOGIT, 0.0)
    picks = {}
    for pick in ("nearest", "farthest"):
        out = predict.nearest_member(samples, near, members(spark), pick)
        picks[pick] = {r["candidate"]: (r["point_idx"], r["lat"]) for r in out.collect()}
    assert picks["nearest"] == {0: (7, 10.1), 1: (None, 0.0)}
    assert picks["farthest"] == {0: (8, 10.2), 1: (None, 0.0)}


def refine(spark, init, candidates, **options):
    samples = spark.createDataFrame([(1, [0.0, 0.0], *init)], "sample_id long, embedding array<double>, init_lat double, init_lon double")
    table = spark.createDataFrame(candidates, "sample_id long, candidate int, geocell_index long, probability double")
    return predict.refine_prediction(samples, table, protos(spark), members(spark), **options).first()


def test_refinement_moves_within_reach_only(spark):
    both = [(1, 0, 2, 0.5), (1, 1, 1, 0.4)]
    row = refine(spark, (10.0, 10.0), both, topk=2)
    assert (row["candidate"], row["geocell_index"], row["lat"]) == (1, 1, 10.1)
    weights = [0.5 * math.exp(-1 / 1.6), 0.4 * 1.0]
    total = math.exp(-1 / 1.6) + 1.0
    assert row["weight"] == pytest.approx(weights[1] / total)
    far = [(1, 0, 2, 0.4), (1, 1, 3, 0.39)]
    assert refine(spark, (10.0, 10.0), far, topk=2)["candidate"] == 0
    assert refine(spark, (59.0, 60.0), far, topk=2)["candidate"] == 1
    km = 50 * math.sqrt(2) * 111
    assert refine(spark, (10.0, 10.0), far, topk=2, max_km=km * 1.2)["candidate"] == 1


def test_refinement_without_probabilities_prototypes_or_candidates(spark):
    samples = spark.createDataFrame([(1, [0.0, 0.0], 10.0, 10.0)], "sample_id long, embedding array<double>, init_lat double, init_lon double")
    plain = spark.createDataFrame([(1, 0, 2), (1, 1, 1)], "sample_id long, candidate int, geocell_index long")
    row = predict.refine_prediction(samples, plain, protos(spark), members(spark), topk=2).first()
    assert row["candidate"] == 0
    lost = refine(spark, (0.0, 0.0), [(1, 0, 50, 0.6), (1, 1, 51, 0.4)], topk=2)
    assert (lost["candidate"], lost["lat"], lost["weight"]) == (0, 0.0, pytest.approx(0.3))
    with pytest.raises(PySparkException):
        refine(spark, (0.0, 0.0), [(1, 0, 1, 1.0)], topk=2)


@pytest.mark.parametrize("farthest", [False, True])
def test_chunks_and_packs_against_brute_force(spark, monkeypatch, farthest):
    """A hot group cut into many chunks and packs, copies of vectors, ties, and a query without a group."""
    monkeypatch.setattr(predict, "PACK_SIZE", 7)
    monkeypatch.setattr(predict, "CHUNK_SIZE", 5)
    rng = np.random.default_rng(4)
    spots = rng.normal(size=(30, 3)).round(1)
    items = [(1 if i % 3 else 2, i, spots[i % 30].tolist()) for i in range(120)]
    rows = [(i, 1 if i % 4 else 2, (spots[i % 30] + (0.0 if i % 2 else 0.05)).tolist()) for i in range(60)]
    rows.append((77, 5, [0.0, 0.0, 0.0]))
    table = spark.createDataFrame(items, "g long, k long, vector array<double>").withColumn("x", F.col("k") * 2)
    asked = spark.createDataFrame([(q, g) for q, g, _ in rows], "sample_id long, g long")
    samples = spark.createDataFrame([(q, v) for q, _, v in rows], "sample_id long, embedding array<double>")
    out = predict.closest_vector(asked, samples, table, ["sample_id"], ["g"], "k", ["x"], farthest)
    got = {r["sample_id"]: (r["k"], r["x"]) for r in out.collect()}
    sign = -1 if farthest else 1
    want = {}
    for q, g, v in rows:
        near = [(sign * round(math.dist(v, w), 9), k) for h, k, w in items if h == g]
        want[q] = (min(near)[1], 2 * min(near)[1]) if near else (None, None)
    assert got == want


def test_losses_by_hand(spark):
    logits = spark.createDataFrame([(1, 0, 2.0), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 0.0)], "sample_id long, geocell_index long, logit double")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "sample_id long, label long")
    n, loss, _ = measures.hard_label_loss(logits, labels).first()
    assert n == 2 and loss == pytest.approx((math.log(1 + math.exp(-2)) + math.log(2)) / 2)
    truth = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.5)], "sample_id long, lat double, lon double")
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 1.0)], "geocell_index long, clat double, clon double")
    w = math.exp(-K.LABEL_RADIUS_M / 1000 * math.radians(1) / 65)
    lp = [-math.log(1 + math.exp(-2)), -2 - math.log(1 + math.exp(-2))]
    want = (-(lp[0] + w * lp[1]) / (1 + w) + math.log(2)) / 2
    assert measures.soft_label_loss(logits, truth, cells).first()[1] == pytest.approx(want)
    lost = spark.createDataFrame([(1, -100000.0), (1, -100000.0)], "k long, x double")
    assert [r["probability"] for r in measures.softmax_temp(lost, "k", "x", 1.6).collect()] == [0.5, 0.5]


def test_prototype_embeddings_average_views_then_members(spark):
    protos_ = spark.createDataFrame([(1, 0, [1, 2, 77]), (2, 0, [3])], "geocell_index long, cluster_id long, indices array<long>")
    rows = [(1, 0.0, 0.0, [1.0, 0.0]), (1, 0.0, 0.0, [3.0, 0.0]), (2, 0.0, 0.0, [10.0, 1.0]), (3, float("inf"), 0.0, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "point_idx long, lat double, lon double, embedding array<float>")
    got = {r["geocell_index"]: (r["n"], list(r["embedding"])) for r in measures.prototype_embeddings(protos_, table, 2).collect()}
    assert got == {1: (2, [6.0, 0.5]), 2: (0, [0.0, 0.0])}


def test_retrieval_counts_every_row(spark):
    left = spark.createDataFrame([(i, [1.0 if i % 2 == 0 else 0.0, 1.0 if i % 2 else 0.0]) for i in range(5)], "id long, embedding array<double>")
    right = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id long, embedding array<double>")
    trials, accuracy = measures.retrieval_accuracy(left, right, 2).first()
    # rows 0, 1 and 2, 3 form batches; row 2 ties between its partners and takes the first, row 3 does too; row 4 is alone.
    assert trials == 3 and accuracy == pytest.approx(0.8)
    assert measures.retrieval_accuracy(left, right, 2, trials=2).first()["accuracy"] == pytest.approx(0.75)
    # the partner of row 1 is missing: a miss, and the others still count
    assert measures.retrieval_accuracy(left, right.where("id <> 1"), 5).first()["accuracy"] == pytest.approx(0.2)


def test_retrieval_compares_unit_vectors(spark):
    left = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "id long, embedding array<double>")
    right = spark.createDataFrame([(0, [1.0, 0.0]), (1, [60.0, 80.0])], "id long, embedding array<double>")
    assert tuple(measures.retrieval_accuracy(left, right, 2).first()) == (1, 1.0)


def test_head_with_gaps_in_class_ids_and_without_classes(spark, monkeypatch):
    samples = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "sample_id long, embedding array<double>")
    weights = spark.createDataFrame([(0, [1.0, 0.0], 0.0), (300_000, [0.0, 1.0], 0.0), (-5, [0.5, 0.5], 0.0)], "geocell_index long, weight array<double>, bias double")
    cells = spark.createDataFrame([(0, 1.0, 2.0)], "geocell_index long, clat double, clon double")
    whole = {r["sample_id"]: (r["geocell_index"], r["pred_lat"], [c["geocell_index"] for c in r["candidates"]]) for r in predict.score_linear_head(samples, weights, cells, 2).collect()}
    assert whole == {1: (0, 1.0, [0, -5, 300_000]), 2: (300_000, None, [300_000, -5, 0])}
    monkeypatch.setattr(predict, "BLOCK_BYTES", 32)  # one class a slice
    sliced = {r["sample_id"]: (r["geocell_index"], r["pred_lat"], [c["geocell_index"] for c in r["candidates"]]) for r in predict.score_linear_head(samples, weights, cells, 2).collect()}
    assert sliced == whole
    assert predict.class_logits(samples, weights, 2).count() == 6
    none = predict.score_linear_head(samples, weights.limit(0), cells, 2).collect()
    assert [(len(r["candidates"]), r["geocell_index"]) for r in none] == [(0, None), (0, None)]
    assert predict.class_logits(samples, weights.limit(0), 2).count() == 0


def test_topk_and_rank_ties_take_the_lower_index(spark):
    p = spark.createDataFrame([(1, 4, 0.3), (1, 2, 0.3), (1, 9, 0.4)], "sample_id long, geocell_index long, probability double")
    got = [(r["candidate"], r["geocell_index"]) for r in predict.topk_candidates(p, 2).orderBy("candidate").collect()]
    assert got == [(0, 9), (1, 2)]


def test_lookups_by_coordinates_and_raster_edges(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, -1.0, 2.0), (3, 89.9, -180.0), (4, 95.0, 0.0)], "id long, lat double, lon double")
    info = spark.createDataFrame(
        [(1, 1.0, 2.0, "A", "a", "g", None), (2, 1.0, 2.0, "B", "b", "h", None)],
        "ord long, lat double, lon double, country string, admin1 string, geocell string, cluster_id long",
    )
    got = {r["id"]: (r["country"], r["cluster_id"]) for r in tables.point_cell_info(points, info).collect()}
    assert got == {1: ("B", -1), 2: (None, None), 3: (None, None), 4: (None, None)}
    raster = spark.createDataFrame([(0, 0, 30), (17, 36, 0), (-1, 36, 5)], "row int, col int, value int").where("row >= 0")
    out = tables.raster_sample(points, raster, (-180.0, 90.0), (5.0, 5.0), K.CLIMATE_LEGEND)
    assert {r["id"]: r["climate"] for r in out.collect()} == {1: None, 2: None, 3: "a polar ice cap climate", 4: None}


def test_losses_count_samples_without_truth_label_or_centroid(spark):
    logits = spark.createDataFrame([(s, c, x) for s in (1, 2, 3) for c, x in ((0, 1.0), (1, 0.0))], "sample_id long, geocell_index long, logit double")
    truth = spark.createDataFrame([(1, 0.0, 0.0), (3, None, 1.0)], "sample_id long, lat double, lon double")
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, None, None)], "geocell_index long, clat double, clon double")
    want = math.log(1 + math.exp(-1.0))  # the class without centroid keeps its probability
    for known in (cells, cells.limit(1)):
        n, loss, missing = measures.soft_label_loss(logits, truth, known).first()
        assert (n, missing) == (3, 2) and loss == pytest.approx(want)
    labels = spark.createDataFrame([(1, 0), (2, 9)], "sample_id long, label long")
    n, loss, missing = measures.hard_label_loss(logits, labels).first()
    assert (n, missing) == (3, 2) and loss == pytest.approx(want)


@pytest.mark.parametrize("block", [None, 200])
def test_losses_from_vectors_equal_those_of_all_logits(spark, monkeypatch, block):
    """Samples without vector, truth or label, classes without centroid or id, repeated rows, and a head of several packs."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3) * 3], float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180)), int(rng.integers(0, 14))) for i in range(60)]
    rows[5] = (5, rows[5][1], None, 3.0, None)
    rows[6] = (6, rows[6][1], float("nan"), 3.0, 99)
    rows.append(rows[7])
    samples = spark.createDataFrame(rows, "sample_id long, embedding array<double>, lat double, lon double, label long").withColumn("_pack", F.lit("own"))
    weights = [(i, [float(v) for v in rng.normal(size=3)], float(rng.normal())) for i in range(13)] + [(None, [9.0, 9.0, 9.0], 9.0), (50, None, 9.0)]
    weights = spark.createDataFrame(weights, "geocell_index long, weight array<double>, bias double")
    cells = spark.createDataFrame([(i, None if i == 2 else 7.0 * i - 40, 20.0 * i - 100) for i in range(12)], "geocell_index long, clat double, clon double")
    if block:
        monkeypatch.setattr(predict, "BLOCK_BYTES", block)
        monkeypatch.setattr(predict, "CHUNK_BYTES", 1000)
    logits = predict.class_logits(samples, weights, 3)
    assert logits.count() == 61 * 13
    truth = samples.where("sample_id <> 7").select("sample_id", "lat", "lon")  # its logits are there twice
    once = logits.where("sample_id <> 7")
    soft = measures.soft_label_loss(once, truth, cells).first()
    assert tuple(predict.soft_head_loss(samples.where("sample_id <> 7"), weights, cells, 3).first()) == pytest.approx(tuple(soft))
    hard = measures.hard_label_loss(once, samples.where("sample_id <> 7").select("sample_id", "label")).first()
    assert tuple(predict.hard_head_loss(samples.where("sample_id <> 7"), weights, 3).first()) == pytest.approx(tuple(hard))
    assert (soft["n"], soft["n_missing"]) == (59, 2) and hard["n"] == 59 and hard["n_missing"] >= 2
    assert predict.hard_head_loss(samples, weights, 3).first()["n"] == 61
    assert predict.score_linear_head(samples, weights, cells, 3).where("sample_id = 7").count() == 2


@pytest.mark.parametrize("block", [None, 100])
def test_head_without_vectors_classes_or_samples(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(predict, "BLOCK_BYTES", block)
    schema = "sample_id long, embedding array<float>, lat double, lon double, label long"
    samples = spark.createDataFrame([(1, None, 1.0, 1.0, 0), (None, [1.0, 0.0], 1.0, 1.0, 0), (3, [None, 1.0], 1.0, 1.0, 0)], schema)
    weights = spark.createDataFrame([(i, [1.0, float(i)], None) for i in range(6)], "geocell_index long, weight array<double>, bias double")
    cells = spark.createDataFrame([(0, 1.0, 1.0)], "geocell_index long, clat double, clon double")
    got = {r["sample_id"]: [c["geocell_index"] for c in r["candidates"]] for r in predict.score_linear_head(samples, weights, cells, 2, 3).collect()}
    assert got == {1: [], None: [0, 1, 2], 3: []}
    assert tuple(predict.soft_head_loss(samples, weights, cells, 2).first()) == (3, pytest.approx(math.log(6)), 2)
    assert tuple(predict.hard_head_loss(samples, weights.limit(0), 2).first()) == (3, None, 3)
    assert predict.score_linear_head(samples.limit(0), weights, cells, 2).count() == 0
    with pytest.raises(PySparkException, match="components"):
        predict.score_linear_head(samples, weights, cells, 5).collect()


def test_nearest_prototype_with_keys_of_two_types(spark):
    """Candidates name cells by bigint, prototypes by int; no task may miss the other side's rows."""
    samples = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "sample_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, 0, i % 20, 0.5) for i in range(40)], "sample_id long, candidate int, geocell_index long, probability double")
    stock = [(c, k, [float(c + 20 * k), 1.0], float(c), float(k)) for c in range(20) for k in range(2)]
    prototypes = spark.createDataFrame(
        stock, "geocell_index int, cluster_id int, embedding array<double>, centroid_lat double, centroid_lon double"
    )
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        out = predict.nearest_prototype(samples, asked, prototypes)
        got = {r["sample_id"]: (r["geocell_index"], r["cluster_id"], r["logit"]) for r in out.collect()}
    finally:
        spark.conf.set(name, before)
    assert dict(out.dtypes)["geocell_index"] == "bigint"
    assert got == {i: (i % 20, i // 20, 0.0) for i in range(40)}
