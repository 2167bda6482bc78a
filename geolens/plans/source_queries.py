"""Queries over sources, sinks, streams and caller-supplied models.

What is read here was written by Spark from the given tables into the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions.geometry import ring_bbox
from geolens.operators import predict, tables
from geolens.plans.predict_queries import EVAL_SQL, cell_names, guess_results, scored
from geolens.plans.scalar_queries import SCORE_SQL, n4
from geolens.plans.views import Tables, haversine, oracle, r4
from geolens.session import work_path
from geolens.sources import exports, images, snapshots, text
from geolens.streaming import ingest

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return add


# ---- image listings ----------------------------------------------------------

_BASE = "regexp_replace(substr(path, 10), '(?i)\\.jpg$', '')"
_LISTING = (
    f"ls AS (SELECT path AS image_path, substr(path, 10) AS name, CAST(split_part({_BASE}, '_', 1) AS DOUBLE) AS lat, CAST(split_part({_BASE}, '_', 2) AS DOUBLE) AS lon, "
    f"CAST(split_part({_BASE}, '_', 3) AS INTEGER) AS heading, split_part({_BASE}, '_', 4) AS capture_date, array_to_string(string_split({_BASE}, '_')[5:], '_') AS pano_id "
    "FROM @image_names WHERE lower(path) LIKE '%.jpg'), "
    "pl AS (SELECT *, printf('%.7f', lat) || '_' || printf('%.7f', lon) AS place FROM ls), "
    "fi AS (SELECT place, min_by(lat, name) AS lat, min_by(lon, name) AS lon, min_by(capture_date, name) AS capture_date, min_by(pano_id, name) AS pano_id FROM pl GROUP BY 1), "
    "li AS (SELECT h.place, heading, ord, image_path, fi.lat, fi.lon, capture_date, pano_id FROM (SELECT place, heading, min(name) AS ord, max_by(image_path, name) AS image_path FROM pl GROUP BY 1, 2) h JOIN fi USING (place))"
)


def listing(t: Tables) -> DataFrame:
    return images.parse_image_listing(t.image_names.select("path"))


@query(f"WITH {_LISTING} SELECT place, heading, image_path, lat, lon, capture_date, pano_id FROM li")
def read_image_listing(t: Tables) -> DataFrame:
    return listing(t).select("place", "heading", "image_path", "lat", "lon", "capture_date", "pano_id")


_INT32 = "printf('%08x', round_even({0} * 1e7::DOUBLE, 0)::BIGINT & 4294967295)"


@query(
    f"WITH {_LISTING} SELECT left(sha1(unhex(hex('geo:v1:') || {_INT32.format('lat')} || {_INT32.format('lon')})), 12) AS location_id, lat, lon, CAST(want AS INTEGER) AS heading, image_path, "
    "capture_date, pano_id FROM (SELECT *, row_number() OVER (PARTITION BY place, want ORDER BY abs((((heading - want + 180) % 360) + 360) % 360 - 180), ord) AS n FROM "
    "(SELECT li.*, q * 90 AS want FROM li, @quarters) x) y WHERE n = 1"
)
def image_records(t: Tables) -> DataFrame:
    return images.image_records(listing(t))


# ---- snapshots ---------------------------------------------------------------

_LATEST = "row_number() OVER (PARTITION BY location_id, heading ORDER BY {0}) AS n"


@query("SELECT location_id, heading, ord, value, batch_date FROM @image_rows")
def write_batch_manifest(t: Tables) -> DataFrame:
    root = work_path(t.spark, "manifest")
    path = snapshots.write_batch_manifest(t.image_rows.drop("is_new"), root, snapshots.new_run_id())
    return t.spark.read.parquet(path)


@query(
    "SELECT location_id, heading, ord, value FROM (SELECT *, row_number() OVER (PARTITION BY location_id, heading ORDER BY is_new DESC, ord DESC) AS n FROM @image_rows) x WHERE n = 1"
)
def snapshot_versions(t: Tables) -> DataFrame:
    """A full version, then a batch published on top, read through the pointer."""
    root, rows = work_path(t.spark, "snapshot"), t.image_rows
    old = tables.dedupe_keep_first(rows.where("is_new = 0"), ["location_id", "heading"], [F.col("ord").desc()])
    snapshots.snapshot_write(old.drop("is_new"), root, "run_ts=2024-01-01T000000Z")
    snapshots.publish_batch(rows.where("is_new = 1").drop("is_new"), root, "run_ts=2024-01-02T000000Z", "ord")
    return snapshots.snapshot_read(t.spark, root).select("location_id", "heading", "ord", "value")


@query(
    f"WITH {_LISTING} SELECT count(*) * 4 AS rows_in_batch, count(*) * 4 AS rows_in_latest, count(*) AS distinct_locations FROM (SELECT DISTINCT place FROM li) x"
)
def ingest_batch(t: Tables) -> DataFrame:
    records = images.image_records(listing(t))
    return snapshots.ingest_batch(records, work_path(t.spark, "ingest"), "2024-01-01")


# ---- text and GeoJSON --------------------------------------------------------

_LINE = "CASE WHEN line LIKE '%,%' THEN string_split(line, ',') ELSE string_split(line, ' ') END"


@query(
    f"SELECT row_number() OVER (ORDER BY point_id) - 1 AS point_idx, lat, lon FROM (SELECT point_id, TRY_CAST(({_LINE})[1] AS DOUBLE) AS lat, TRY_CAST(({_LINE})[2] AS DOUBLE) AS lon FROM @point_lines) x WHERE lat IS NOT NULL AND lon IS NOT NULL"
)
def read_points_text(t: Tables) -> DataFrame:
    """Lines written in id order, several blocks per file, numbered while reading."""
    path = work_path(t.spark, "lines")
    t.point_lines.repartitionByRange(4, "point_id").sortWithinPartitions("point_id").select("line").write.text(path)
    return text.read_points_text(t.spark, path)


def prototype_rows(t: Tables) -> DataFrame:
    lists = t.members.groupBy("geocell_index", "cluster_id", F.expr("point_idx div 64").alias("chunk"))
    return lists.agg(
        F.array_sort(F.collect_list("point_idx")).alias("indices"),
        F.count(F.lit(1)).alias("count"),
        F.min("lat").alias("centroid_lat"),
        F.min("lon").alias("centroid_lng"),
    ).select(
        F.col("geocell_index").cast("bigint").alias("geocell_index"),
        F.lit("land").alias("country"),
        F.lit("area").alias("admin1"),
        F.col("chunk").cast("string").alias("cell_id"),
        F.col("cluster_id").cast("bigint").alias("cluster_id"),
        "count",
        "indices",
        "centroid_lat",
        "centroid_lng",
    )


_PROTO_ROWS = (
    "SELECT CAST(geocell_index AS BIGINT) AS geocell_index, CAST(point_idx // 64 AS VARCHAR) AS cell_id, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS count, "
    "array_to_string(list(point_idx ORDER BY point_idx), ',') AS indices, min(lat) AS centroid_lat, min(lon) AS centroid_lng FROM @members GROUP BY 1, 2, 3"
)


def _listed(df: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices")
    return df.select("geocell_index", "cell_id", "cluster_id", "count", ids, "centroid_lat", "centroid_lng")


@query(_PROTO_ROWS)
def read_prototypes(t: Tables) -> DataFrame:
    path = work_path(t.spark, "prototypes-csv")
    text.write_prototypes(prototype_rows(t), path, "csv")
    return _listed(text.read_prototypes(t.spark, path))


@query(_PROTO_ROWS)
def write_prototypes(t: Tables) -> DataFrame:
    path = work_path(t.spark, "prototypes")
    text.write_prototypes(prototype_rows(t), path)
    return _listed(t.spark.read.parquet(path))


@query(
    "SELECT c_name AS country, CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE (c_custkey % 100) / 100.0::DOUBLE END AS rate FROM customer"
)
def country_rates_text(t: Tables) -> DataFrame:
    """Name and rate split at the comma, at the blank where the comma is missing, or without a rate."""
    key, name = F.col("c_custkey"), F.col("c_name")
    rate = F.format_string("%.2f", (key % 100) / 100.0)
    line = F.when(key % 6 == 5, name).when(key % 6 == 4, F.concat_ws(" ", name, rate)).otherwise(F.concat_ws(", ", name, rate))
    path = work_path(t.spark, "rates")
    t.customer.select(line.alias("line")).write.text(path)
    return text.read_country_rates(t.spark, path)


@query(
    "SELECT CASE WHEN geocell_index % 2 = 0 THEN 'land ' || admin0 ELSE NULL END AS country, 'area ' || geocell_index AS name_1, q AS part_id, min_x, max_y, 162.0::DOUBLE AS area FROM "
    "(SELECT geocell_index, admin0, CAST(q AS INTEGER) AS q, min_x + q * 10 AS min_x, max_y FROM @boxes, @quarters) x"
)
def read_boundaries(t: Tables) -> DataFrame:
    """Boundary files written from the boxes, one per box; half of them name no country."""
    folder = work_path(t.spark, "boundaries")

    def strips() -> list:
        out = []
        for q in range(4):
            x0, x1 = F.col("min_x") + q * 10, F.col("min_x") + q * 10 + 4.5
            y0, y1 = F.col("min_y"), F.col("max_y")
            ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
            out.append(F.array(ring))
        return out

    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.when(F.col("geocell_index") % 2 == 0, F.concat(F.lit("land "), F.col("admin0").cast("string"))).alias("COUNTRY"),
            F.concat(F.lit("area "), F.col("geocell_index").cast("string")).alias("NAME_1"),
        ).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.array(*strips()).alias("coordinates")).alias("geometry"),
    )
    collection = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    files = t.boxes.select("geocell_index", collection.alias("value"))
    files.repartition("geocell_index").write.partitionBy("geocell_index").text(folder)
    found = text.read_boundaries(t.spark, f"{folder}/*", pattern="*.txt")
    box = ring_bbox(F.col("rings")[0])
    named = F.when(F.col("country").startswith("land"), F.col("country"))
    return found.select(
        named.alias("country"), "name_1", "part_id", n4(box["min_x"]).alias("min_x"), box["max_y"].alias("max_y"), n4("area").alias("area")
    )


@query(
    "SELECT point_id, 'Point' AS kind, lon AS x, lat AS y, country_id AS prop FROM @loc_points UNION ALL "
    "SELECT geocell_index, 'Polygon', min_x, min_y, admin0 FROM @boxes UNION ALL SELECT point_id, 'LineString', pred_lon, pred_lat, country_id FROM @guesses"
)
def geojson_features(t: Tables) -> DataFrame:
    """Points, boxes and arcs as feature texts, taken apart again for comparison."""
    parts = [
        (exports.geojson_features(t.loc_points, "point", ["point_id", "country_id"]), "point_id", "country_id", "$.geometry.coordinates[{0}]"),
        (exports.geojson_features(t.boxes, "box", ["geocell_index", "admin0"]), "geocell_index", "admin0", "$.geometry.coordinates[0][0][{0}]"),
        (
            exports.geojson_features(
                t.guesses.withColumnsRenamed({"pred_lat": "to_lat", "pred_lon": "to_lon"}), "arc", ["point_id", "country_id"]
            ),
            "point_id",
            "country_id",
            "$.geometry.coordinates[1][{0}]",
        ),
    ]
    out = None
    for df, key, prop, path in parts:
        def at(where: str, kind: str):
            return F.get_json_object("feature", where).cast(kind)

        rows = df.select(
            at(f"$.properties.{key}", "bigint").alias("point_id"),
            at("$.geometry.type", "string").alias("kind"),
            at(path.format(0), "double").alias("x"),
            at(path.format(1), "double").alias("y"),
            at(f"$.properties.{prop}", "int").alias("prop"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- results and annotations -------------------------------------------------

_KM = haversine("lat", "lon", "pred_lat", "pred_lon", K.SCORE_RADIUS_M)


@query(
    f"SELECT point_id AS sample_id, lat, pred_lat, CASE WHEN country_id = 4 THEN 0.0::DOUBLE ELSE {r4(_KM)} END AS distance_km, CASE WHEN country_id = 5 THEN 0.0::DOUBLE ELSE top1_prob END AS top1_prob "
    "FROM @guesses WHERE country_id <> 3"
)
def results_read(t: Tables) -> DataFrame:
    """Records of country 3 have a coordinate that is no number; others lack distance or candidates."""
    path, c = work_path(t.spark, "results"), F.col("country_id")
    rows = guess_results(t).select(
        F.col("point_id").alias("sample_id"),
        F.struct(F.when(c == 3, F.lit("north")).otherwise(F.col("lat").cast("string")).alias("lat"), "lon").alias("ground_truth"),
        F.struct(F.col("pred_lat").alias("lat"), F.col("pred_lon").alias("lon")).alias("prediction"),
        F.when(c != 4, F.col("distance_km")).alias("distance_km"),
        "score",
        F.when(c != 5, F.array(F.struct(F.lit(1).alias("geocell_index"), F.col("top1_prob").alias("probability")))).alias("top5_geocells"),
    )
    summary = rows.agg(F.count(F.lit(1)).alias("num_samples"))
    exports.results_write(rows, path, summary)
    back = exports.results_read(t.spark, path)
    return back.select("sample_id", "lat", "pred_lat", n4("distance_km").alias("distance_km"), "top1_prob")


@query(
    f"WITH {EVAL_SQL} SELECT sample_id, s.lat, s.lon, clat AS pred_lat, clon AS pred_lon, {r4('km')} AS distance_km, CAST({SCORE_SQL.format('km')} AS DOUBLE) AS score, "
    f"{r4('probability')} AS top1_prob FROM ev JOIN @samples s USING (sample_id)"
)
def results_write(t: Tables) -> DataFrame:
    """Evaluation results and their summary written as JSON and read back whole."""
    path = work_path(t.spark, "evaluation")
    results, summary = predict.evaluate(scored(t), t.samples, cell_names(t))
    exports.results_write(results.drop("true_cell"), path, summary)
    back = exports.results_read(t.spark, path)
    return back.withColumns({c: n4(c) for c in ("distance_km", "top1_prob")})


@query(
    "SELECT '/img/' || p_partkey || '.jpg' AS img_path, dense_rank() OVER (ORDER BY p_brand) - 1 AS gt_label FROM part"
)
def annotation_export(t: Tables) -> DataFrame:
    path = work_path(t.spark, "annotations")
    rows = t.part.select(F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), "p_brand")
    exports.annotation_export(rows, path, "path", "p_brand")
    return t.spark.read.schema("img_path string, gt_label bigint").json(path)


def _profile_sql() -> str:
    columns = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
    arms = [
        f"SELECT '{name}' AS \"column\", '{kind}' AS dtype, count(*) AS rows, count({name}) = 0 AS all_null, CAST(min_by({name}, c_custkey) AS VARCHAR) AS sample FROM customer"
        for name, kind in columns.items()
    ]
    arms.append("SELECT 'nothing', 'string', count(*), true, NULL FROM customer")
    arms.append("SELECT 'long_text', 'string', count(*), false, left(repeat(min_by(c_name, c_custkey), 9), 50) || '...' FROM customer")
    return " UNION ALL ".join(arms)


@query(_profile_sql())
def table_profile(t: Tables) -> DataFrame:
    wide = t.customer.withColumns({"nothing": F.lit(None).cast("string"), "long_text": F.repeat("c_name", F.lit(9))})
    return exports.table_profile(wide, "c_custkey")


# ---- image and embedding tables ----------------------------------------------


@query(
    "SELECT location_id, heading, ord, n_bytes FROM (SELECT location_id, heading, ord, n_bytes, row_number() OVER (PARTITION BY location_id, heading ORDER BY ord DESC) AS n FROM @image_rows r "
    "JOIN (SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents) d ON d.doc_id = r.ord % 1500) x WHERE n = 1"
)
def build_image_table(t: Tables) -> DataFrame:
    """Document texts stand for image bytes; rows whose file is missing are left out."""
    path = F.concat(F.lit("img/"), (F.col("ord") % 1500).cast("string"))
    snapshot = t.image_rows.drop("is_new", "value").withColumn("image_path", path)
    blobs = t.documents.select(
        F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("image_path"), F.col("text").cast("binary").alias("image")
    )
    out = images.build_image_table(snapshot, blobs)
    return out.select("location_id", "heading", "ord", F.octet_length("image").cast("bigint").alias("n_bytes"))


def byte_model():
    """A stand-in for an encoder: length, first byte and byte sum of each image."""

    def run(blobs):
        if any(len(b) == 0 for b in blobs):
            raise ValueError("empty image")
        return np.array([[len(b), b[0], sum(b) % 1000] for b in blobs], dtype=np.float32)

    return run


@query(
    "SELECT event_id, ok, CASE WHEN ok THEN octet_length(encode(props))::DOUBLE ELSE 0.0::DOUBLE END AS e0, CASE WHEN ok THEN 123.0::DOUBLE ELSE 0.0::DOUBLE END AS e1 "
    "FROM (SELECT *, event_id % 17 NOT IN (0, 1) AS ok FROM events) x"
)
def map_embeddings(t: Tables) -> DataFrame:
    """Properties stand for images; some are missing and some cannot be decoded."""
    image = F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 17 == 1, F.lit("")).otherwise(F.col("props"))
    rows = t.events.select("event_id", image.cast("binary").alias("image"))
    out = images.map_embeddings(rows, byte_model, 256, 3)
    vector = F.col("embedding")
    return out.select("event_id", "ok", vector[0].cast("double").alias("e0"), vector[1].cast("double").alias("e1"))


@query(
    "SELECT event_id, octet_length(encode(props))::DOUBLE AS emb_0, 123.0::DOUBLE AS emb_1, CAST(3 AS INTEGER) AS embedding_dim FROM events WHERE event_id % 17 <> 0"
)
def build_embedding_table(t: Tables) -> DataFrame:
    image = F.when(F.col("event_id") % 17 != 0, F.col("props"))
    rows = t.events.select("event_id", image.cast("binary").alias("image"))
    out = images.build_embedding_table(rows, byte_model, 256, 3, wide=True)
    return out.select(
        "event_id", F.col("emb_0").cast("double").alias("emb_0"), F.col("emb_1").cast("double").alias("emb_1"), "embedding_dim"
    )


# ---- streams -----------------------------------------------------------------


def _stream_files(t: Tables, df: DataFrame, order: str, label: str, batches: int = 4) -> DataFrame:
    """Deliver a table as batches in id order, one file each, and open them as a stream of one file per micro-batch."""
    folder = work_path(t.spark, label)
    last = df.agg(F.max(order)).first()[0]
    step = last // batches + 1
    for batch in range(batches):
        part = df.where(F.col(order).between(batch * step, (batch + 1) * step - 1))
        part.coalesce(1).write.mode("append").parquet(folder)
    return ingest.read_file_stream(t.spark, folder, df.schema)


@query(
    "SELECT location_id, heading, ord, value FROM (SELECT *, row_number() OVER (PARTITION BY location_id, heading ORDER BY ord DESC) AS n FROM @image_rows) x WHERE n = 1"
)
def stream_ingest(t: Tables) -> DataFrame:
    root = work_path(t.spark, "stream")
    stream = _stream_files(t, t.image_rows.drop("is_new"), "ord", "stream-in")
    ingest.stream_ingest(stream, root, work_path(t.spark, "stream-state"), compact_every=3).awaitTermination()
    return snapshots.snapshot_read(t.spark, root).select("location_id", "heading", "ord", "value")


@query(
    "SELECT DISTINCT CASE WHEN lat > 0 THEN 'collected' ELSE 'failed' END AS ledger, lat, lon FROM @loc_points"
)
def stream_ledgers(t: Tables) -> DataFrame:
    root = work_path(t.spark, "ledger")
    points = t.loc_points.select("point_id", "lat", "lon", (F.col("lat") > 0).alias("ok"))
    stream = _stream_files(t, points, "point_id", "ledger-in")
    ingest.stream_ledgers(stream, root, work_path(t.spark, "ledger-state")).awaitTermination()
    parts = [ingest.read_ledger(t.spark, root, name).withColumn("ledger", F.lit(name)) for name in ingest.LEDGERS]
    return parts[0].unionByName(parts[1]).select("ledger", "lat", "lon")
