"""Readers, writers, versions, streams and the embedding function."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.sources import exports, images, snapshots, text
from geolens.streaming import ingest


def test_listing_of_a_folder(spark, tmp_path):
    names = [
        "59.1_10.2_0_2020-01_pano_a.jpg", "59.1_10.2_90_2020-02_pano-b.JPG", "59.1_10.2000000_0_2021-05_zz.jpg",
        "bad.jpg", "x_1_2_3_4.jpg", "1_2_3_4.jpg", "59.1_10.2_180_2020-01_note.txt",
    ]
    for name in names:
        (tmp_path / name).write_bytes(b"x")
    rows = {r["heading"]: r for r in images.read_image_listing(spark, str(tmp_path)).collect()}
    assert set(rows) == {0, 90}
    assert rows[0]["image_path"].endswith("59.1_10.2_0_2020-01_pano_a.jpg")
    assert (rows[90]["capture_date"], rows[90]["pano_id"]) == ("2021-05", "zz")
    records = images.image_records(images.read_image_listing(spark, str(tmp_path))).collect()
    assert sorted(r["heading"] for r in records) == [0, 90, 180, 270]
    used = {r["heading"]: r["image_path"].rsplit("/", 1)[1].split("_")[2] for r in records}
    assert used == {0: "0", 90: "90", 180: "90", 270: "0"}


def batch(spark, rows):
    return spark.createDataFrame(rows, "location_id string, heading int, ord long, note string")


def test_versions_replays_and_compaction(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshots.snapshot_read(spark, root)
    for i in range(5):
        rows = [("hot", 0, 10 * i, f"v{i}"), ("hot", 0, 10 * i + 1, f"w{i}"), (f"loc{i}", 90, i, "only")]
        snapshots.publish_batch(batch(spark, rows), root, f"run_ts={i}", "ord", compact_every=3)
        if i == 3:
            snapshots.publish_batch(batch(spark, rows), root, f"run_ts={i}", "ord", compact_every=3)
    got = {(r["location_id"], r["note"]) for r in snapshots.snapshot_read(spark, root).collect()}
    assert got == {("hot", "w4")} | {(f"loc{i}", "only") for i in range(5)}
    assert snapshots._pointer(spark, root, "_latest")["run_id"] == "run_ts=4"
    snapshots.snapshot_write(batch(spark, []), root, "run_ts=9")
    with pytest.raises(FileNotFoundError):
        snapshots.snapshot_read(spark, root)
    snapshots.snapshot_write(batch(spark, [("h", 0, 1, "x")]), root, "run_ts=1", pointer=snapshots.HOLDOUT)
    assert snapshots.snapshot_read(spark, root, snapshots.HOLDOUT).count() == 1


def test_versions_follow_their_publication_not_their_names(spark, tmp_path):
    root = str(tmp_path)
    for run_id, place in (("run_ts=stream-0000000000", "a"), ("run_ts=2026-01-01", "b"), ("run_ts=1999-01-01", "c")):
        snapshots.publish_batch(batch(spark, [(place, 0, 1, run_id)]), root, run_id, "ord")
    assert {r["location_id"] for r in snapshots.snapshot_read(spark, root).collect()} == {"a", "b", "c"}
    assert snapshots._pointer(spark, root, "_latest")["run_id"] == "run_ts=1999-01-01"


@pytest.mark.parametrize("compact_every", [3, 16])
def test_two_writers_at_once_lose_no_batch(spark, tmp_path, monkeypatch, compact_every):
    """Two writers list the versions at the same time; then each publishes what it has, also as a fold or a whole table."""
    root, names = str(tmp_path), lambda: {(r["location_id"], r["note"]) for r in snapshots.snapshot_read(spark, root).collect()}
    publish = lambda place, run: snapshots.publish_batch(batch(spark, [("hot", 0, 1, run), (place, 0, 1, run)]), root, f"run_ts={run}", "ord", compact_every=compact_every)
    for place in "abc":
        publish(place, place)
    seen = snapshots._entries(spark, root, "_latest")
    publish("d", "d")
    with monkeypatch.context() as late:
        late.setattr(snapshots, "_entries", lambda *_: seen)
        publish("e", "e")
    assert names() == {("hot", "e")} | {(p, p) for p in "abcde"}
    publish("f", "f")
    assert names() == {("hot", "f")} | {(p, p) for p in "abcdef"}
    seen = snapshots._entries(spark, root, "_latest")
    publish("g", "g")
    with monkeypatch.context() as late:
        late.setattr(snapshots, "_entries", lambda *_: seen)
        for run in ("x", "y"):
            snapshots.snapshot_write(batch(spark, [(run, 0, 1, run)]), root, f"run_ts={run}")
    assert names() == {("y", "y"), ("g", "g"), ("hot", "g")}  # whole tables replace what they saw and each other
    publish("z", "z")
    assert names() == {("y", "y"), ("g", "g"), ("z", "z"), ("hot", "z")}


def test_a_known_version_is_not_overwritten(spark, tmp_path):
    root = str(tmp_path)
    snapshots.publish_batch(batch(spark, [("a", 0, 1, "x")]), root, "run_ts=1", "ord")
    with pytest.raises(ValueError):
        snapshots.publish_batch(batch(spark, [("b", 0, 1, "y")]), root, "run_ts=1", "ord")
    with pytest.raises(ValueError):
        snapshots.snapshot_write(batch(spark, [("b", 0, 1, "y")]), root, "run_ts=1")
    snapshots.snapshot_write(batch(spark, [("h", 0, 1, "z")]), root, "run_ts=1", pointer=snapshots.HOLDOUT)
    assert [r["note"] for r in snapshots.snapshot_read(spark, root).collect()] == ["x"]
    assert len({snapshots.new_run_id() for _ in range(100)}) == 100


def test_new_columns_become_null_in_old_rows(spark, tmp_path):
    root = str(tmp_path)
    snapshots.snapshot_write(batch(spark, [("a", 0, 1, "x")]).drop("note"), root, "run_ts=1")
    snapshots.publish_batch(batch(spark, [("b", 0, 1, "y")]), root, "run_ts=2", "ord")
    assert {r["location_id"]: r["note"] for r in snapshots.snapshot_read(spark, root).collect()} == {"a": None, "b": "y"}


def test_ingest_report(spark, tmp_path):
    rows = batch(spark, [("a", 0, 1, "x"), ("a", 90, 1, "x"), ("b", 0, 1, "x")])
    first = snapshots.ingest_batch(rows, str(tmp_path), "2024-01-01", "run_ts=1", "ord").first()
    again = snapshots.ingest_batch(rows.where("location_id = 'a'"), str(tmp_path), "2024-01-02", "run_ts=2", "ord").first()
    assert tuple(first) == (3, 3, 2) and tuple(again) == (2, 3, 2)
    latest = snapshots.snapshot_read(spark, str(tmp_path))
    assert {(r["location_id"], r["batch_date"]) for r in latest.collect()} == {("a", "2024-01-02"), ("b", "2024-01-01")}


def test_point_lines(spark, tmp_path):
    lines = ["1.5,2.5", "  3 4 ", "x,y", "", "5,6,7", "7,", "-1e1, +2", "8\t9", "nan"]
    (tmp_path / "points.txt").write_text("\n".join(lines))
    got = [tuple(r) for r in text.read_points_text(spark, str(tmp_path / "points.txt")).orderBy("point_idx").collect()]
    assert got == [(0, 1.5, 2.5), (1, 3.0, 4.0), (2, -10.0, 2.0), (3, 8.0, 9.0)]


def test_point_lines_over_many_blocks(spark, tmp_path):
    (tmp_path / "many.txt").write_text("\n".join(f"{i},{-i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = text.read_points_text(spark, str(tmp_path / "many.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r["point_idx"] == r["lat"] == -r["lon"] for r in rows)


def test_indices_texts(spark):
    texts = ["[1, 2, 3]", "(4 5)", "7", "", None, "[8, x, 9.5, 10]", "{11}"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(text.parse_indices(F.col("t"))).collect()]
    assert got == [[1, 2, 3], [4, 5], [7], [], [], [8, 10], [11]]


def test_country_rates(spark):
    lines = ["Albania, 0.10", "Estonia", "South Africa 0.25", "  ", "Bonaire, Sint Eustatius, 0.5"]
    frame = spark.createDataFrame([(s,) for s in lines], "line string")
    assert [tuple(r) for r in text.parse_country_rates(frame).collect()] == [
        ("Albania", 0.1), ("Estonia", None), ("South Africa", 0.25), ("Bonaire, Sint Eustatius", 0.5),
    ]


def test_boundaries(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]]
    named = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"COUNTRY": "Norway", "NAME_1": "Viken"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"NAME_0": "Sweden"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, [square[0]]]}},
    ]}
    unnamed = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": square}}]}
    (tmp_path / "a_b.json").write_text(json.dumps(named, indent=1))
    (tmp_path / "gadm41_AFG_0.geojson").write_text(json.dumps(unnamed))
    (tmp_path / "broken_x.json").write_text("{ not json")
    (tmp_path / "notes.txt").write_text("x")
    rows = text.read_boundaries(spark, str(tmp_path)).collect()
    got = sorted((r["country"], r["name_1"] or "", r["part_id"], len(r["rings"]), r["area"]) for r in rows)
    assert got == [("AFG", "", 0, 2, 4.0), ("Norway", "Viken", 0, 2, 4.0), ("Sweden", "", 0, 2, 4.0), ("Sweden", "", 1, 1, 4.0)]


def test_prototypes_written_and_read(spark, tmp_path):
    rows = [(1, "Norway", "Viken", "c1", -1, 3, [1, 2, 3], 1.5, 2.5), (2, "Norway", "Viken", "c2", 0, 0, [], 1.5, 2.5)]
    frame = spark.createDataFrame(rows, text.PROTOTYPE_SCHEMA.replace("indices string", "indices array<bigint>"))
    for fmt in ("csv", "parquet"):
        text.write_prototypes(frame, f"{tmp_path}/{fmt}", fmt)
    assert sorted(map(tuple, text.read_prototypes(spark, f"{tmp_path}/csv").collect())) == rows
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/parquet").collect())) == rows


def test_results_with_bad_records(spark, tmp_path):
    good = {"sample_id": 1, "ground_truth": {"lat": 1, "lon": 2}, "prediction": {"lat": "3.5", "lon": 4}, "distance_km": 5, "score": 6,
            "top5_geocells": [{"geocell_index": 1, "probability": 0.5}]}
    rows = [good, {**good, "sample_id": 2, "distance_km": None, "top5_geocells": []}, {**good, "prediction": {"lat": "x", "lon": 1}},
            {"ground_truth": {"lat": 1}}, {"summary": True, "num_samples": 2}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    got = sorted(map(tuple, exports.results_read(spark, str(tmp_path / "r.json")).collect()))
    assert got == [(1, 1.0, 2.0, 3.5, 4.0, 5.0, 6.0, 0.5), (2, 1.0, 2.0, 3.5, 4.0, 0.0, 6.0, 0.0)]


def test_features_and_profile(spark):
    frame = spark.createDataFrame([(1, 2.0, 3.0, "x" * 60), (2, 4.0, 5.0, None)], "id long, lat double, lon double, note string")
    feature = json.loads(exports.geojson_features(frame, "point", ["id"]).first()[0])
    assert feature == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [3.0, 2.0]}, "properties": {"id": 1}}
    with pytest.raises(ValueError):
        exports.geojson_features(frame, "circle", ["id"])
    profile = {r["column"]: tuple(r)[1:] for r in exports.table_profile(frame.withColumn("gone", F.lit(None).cast("int")), "id").collect()}
    assert profile["note"] == ("string", 2, False, "x" * 50 + "...")
    assert profile["gone"] == ("int", 2, True, None) and profile["lat"] == ("double", 2, False, "2.0")


def test_image_table_and_embeddings(spark):
    snapshot = spark.createDataFrame(
        [("a", 0, 1, "p1"), ("a", 0, 2, "p2"), ("b", 90, 3, "gone"), ("c", 0, 4, "null"), ("d", 0, 5, "p2")],
        "location_id string, heading int, ord long, image_path string",
    )
    blobs = spark.createDataFrame([("p1", b"one"), ("p2", b"three"), ("null", None)], "image_path string, image binary")
    table = images.build_image_table(snapshot, blobs)
    assert {(r["location_id"], bytes(r["image"])) for r in table.collect()} == {("a", b"three"), ("d", b"three")}
    assert set(K.SNAPSHOT_SCHEMA.replace(",", " ").split()[::2]) <= set(table.columns)
    assert images.build_image_table(snapshot, blobs, max_rows=1).first()["location_id"] == "a"

    def load():
        def model(batch):
            if any(b == b"bad" for b in batch):
                raise ValueError
            return np.array([[len(b), 1.0] for b in batch])

        return model

    rows = spark.createDataFrame([(1, b"four"), (2, None), (3, b"bad"), (4, b"x")], "id long, image binary").coalesce(1)
    got = {r["id"]: (list(r["embedding"]), r["ok"]) for r in images.map_embeddings(rows, load, 3, 2).collect()}
    assert got == {1: ([4.0, 1.0], True), 2: ([0.0, 0.0], False), 3: ([0.0, 0.0], False), 4: ([1.0, 1.0], True)}
    wide = images.build_embedding_table(rows, load, 2, 2, wide=True)
    assert sorted(map(tuple, wide.select("id", "emb_0", "emb_1", "embedding_dim").collect())) == [(1, 4.0, 1.0, 2), (4, 1.0, 1.0, 2)]


def test_streams_resume_and_replay(spark, tmp_path):
    folder, root, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "location_id string, heading int, ord long, note string"

    def deliver(rows):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(folder)

    def run(checkpoint):
        stream = ingest.read_file_stream(spark, folder, schema)
        ingest.stream_ingest(stream, root, checkpoint).awaitTermination()
        return {r["location_id"]: r["note"] for r in snapshots.snapshot_read(spark, root).collect()}

    deliver([("a", 0, 1, "old"), ("a", 0, 2, "mid")])
    deliver([("b", 0, 3, "b")])
    assert run(state) == {"a": "mid", "b": "b"}
    deliver([("a", 0, 4, "new")])
    assert run(state) == {"a": "new", "b": "b"}
    assert run(str(tmp_path / "fresh")) == {"a": "new", "b": "b"}


def test_ledgers(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1.0, 1.0, True), (1.0, 1.0, True), (2.0, 2.0, False), (3.0, 3.0, None)]
    for _ in range(2):
        spark.createDataFrame(rows, "lat double, lon double, ok boolean").coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.read_file_stream(spark, folder, "lat double, lon double, ok boolean")
    ingest.stream_ledgers(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {n: sorted(map(tuple, ingest.read_ledger(spark, str(tmp_path / "out"), n).collect())) for n in ingest.LEDGERS}
    assert got == {"collected": [(1.0, 1.0)], "failed": [(2.0, 2.0), (3.0, 3.0)]}
