"""GeoJSON features, result files, annotations and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolens.operators.tables import apply_label_map, label_map


def _position(x: Column, y: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"))


def _shape(kind: str) -> Column:
    """Geometry struct built from the columns a kind needs.

    point: lat, lon.  box: min_x, min_y, max_x, max_y.  cell: ring.  arc: lat, lon, to_lat, to_lon.
    """
    c = F.col
    if kind == "point":
        return F.struct(F.lit("Point").alias("type"), _position(c("lon"), c("lat")).alias("coordinates"))
    if kind == "box":
        ring = F.array(
            _position(c("min_x"), c("min_y")),
            _position(c("max_x"), c("min_y")),
            _position(c("max_x"), c("max_y")),
            _position(c("min_x"), c("max_y")),
            _position(c("min_x"), c("min_y")),
        )
        return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    if kind == "cell":
        ring = F.transform("ring", lambda p: _position(p["x"], p["y"]))
        return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    if kind == "arc":
        line = F.array(_position(c("lon"), c("lat")), _position(c("to_lon"), c("to_lat")))
        return F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))
    raise ValueError(f"unknown kind {kind}")


def geojson_features(df: DataFrame, kind: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON Feature text per row."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        _shape(kind).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.select(F.to_json(feature).alias("feature"))


def results_write(results: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """Result records as JSON lines, followed by a summary record when given."""
    results.write.mode("overwrite").json(path)
    if summary is not None:
        summary.withColumn("summary", F.lit(True)).write.mode("append").json(path)


RESULT_SCHEMA = (
    "summary boolean, sample_id bigint, ground_truth struct<lat: string, lon: string>, "
    "prediction struct<lat: string, lon: string>, distance_km string, score string, "
    "top5_geocells array<struct<geocell_index: bigint, probability: double, country: string, admin1: string>>"
)


def results_read(spark: SparkSession, path: str) -> DataFrame:
    """Result records with usable coordinates; summary records are left out."""
    raw = spark.read.schema(RESULT_SCHEMA).json(path).where(~F.coalesce("summary", F.lit(False)))

    def number(name: str) -> Column:
        return F.col(name).try_cast("double")

    flat = raw.select(
        "sample_id",
        number("ground_truth.lat").alias("lat"),
        number("ground_truth.lon").alias("lon"),
        number("prediction.lat").alias("pred_lat"),
        number("prediction.lon").alias("pred_lon"),
        F.coalesce(number("distance_km"), F.lit(0.0)).alias("distance_km"),
        F.coalesce(number("score"), F.lit(0.0)).alias("score"),
        F.coalesce(F.try_element_at("top5_geocells", F.lit(1))["probability"], F.lit(0.0)).alias("top1_prob"),
    )
    return flat.where("lat IS NOT NULL AND lon IS NOT NULL AND pred_lat IS NOT NULL AND pred_lon IS NOT NULL")


def annotation_records(df: DataFrame, path: str, label: str, labels: DataFrame | None = None) -> DataFrame:
    """Records {img_path, gt_label} with numbered labels."""
    numbered = apply_label_map(df, label, labels if labels is not None else label_map(df, label))
    return numbered.select(F.col(path).alias("img_path"), F.col("label_id").alias("gt_label"))


def annotation_export(df: DataFrame, out: str, path: str, label: str, labels: DataFrame | None = None) -> DataFrame:
    records = annotation_records(df, path, label, labels)
    records.write.mode("overwrite").json(out)
    return records


def table_profile(df: DataFrame, order: str, sample_len: int = 50) -> DataFrame:
    """Type, row count, all-null flag and first non-null value of every column, in one pass.

    The first value is the one with the smallest ``order``; long texts are cut for display.
    """
    measures = []
    for name, dtype in df.dtypes:
        value = F.col(name).cast("string")
        first = F.min_by(value, F.when(value.isNotNull(), F.col(order)))
        shown = F.when(F.length(first) > sample_len, F.concat(F.left(first, F.lit(sample_len)), F.lit("..."))).otherwise(first)
        measures.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"),
                F.count(F.lit(1)).alias("rows"),
                (F.count(value) == 0).alias("all_null"),
                shown.alias("sample"),
            )
        )
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))
