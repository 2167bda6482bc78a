"""Turning a snapshot into a training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions.scalar import drive_right, fill_optional_columns, month_features
from geolens.operators.tables import point_cell_info, raster_sample


def enrich_snapshot(
    snapshot: DataFrame,
    cell_points: DataFrame,
    raster: DataFrame,
    origin: tuple[float, float],
    pixel: tuple[float, float],
    legend: dict | None = None,
    left_driving: list[str] = K.LEFT_DRIVING,
) -> DataFrame:
    """Add month, country, region, cell, cluster, climate and driving side to every row.

    Climate is written under the one name captions read.
    """
    dated = fill_optional_columns(snapshot, "batch_date string, capture_date string")
    dated = dated.withColumn("month", month_features(F.col("batch_date"), F.col("capture_date")))
    placed = point_cell_info(dated, cell_points).withColumnsRenamed({"admin1": "region", "geocell": "cell"})
    climate = raster_sample(placed, raster, origin, pixel, legend or K.CLIMATE_LEGEND, "climate")
    return climate.withColumn("drive_right", drive_right(F.col("country"), left_driving))
