"""Point lists, prototype tables and boundaries read from text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions.geometry import ring_area
from geolens.operators.spread import running_total


def parse_point_line(line: Column) -> Column:
    """``lat,lon`` or ``lat lon`` as a struct; NULL for anything else."""
    text = F.trim(line)
    parts = F.when(text.contains(","), F.split(text, ",")).otherwise(F.split(text, r"\s+"))
    lat = F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double")
    lon = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    good = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    """Points of a text file with their position among the valid lines.

    Positions follow file, then offset of the read block, then line.  Rows are
    numbered inside each block; the counts of the blocks are summed range by range
    and joined back, so the number of blocks is not bounded by one task.
    """
    lines = spark.read.text(path).select(
        parse_point_line(F.col("value")).alias("p"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    valid = lines.where(F.col("p").isNotNull())
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_line"))
    numbered = valid.withColumn("_at", inside)
    counts = valid.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    summed = running_total(counts, [], [F.col("_file"), F.col("_block")], F.col("_n"), "_upto")
    joined = numbered.join(summed.withColumn("_offset", F.col("_upto") - F.col("_n")), ["_file", "_block"])
    return joined.select((F.col("_at") + F.col("_offset") - 1).alias("point_idx"), "p.lat", "p.lon")


def parse_indices(text: Column) -> Column:
    """``[1, 2, 3]``, ``(1 2)``, ``7`` or blank as an id list; other elements are dropped."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\](){}]", " "))
    items = F.transform(F.split(bare, r"[,\s]+"), lambda s: s.try_cast("bigint"))
    return F.filter(items, lambda i: i.isNotNull())


PROTOTYPE_SCHEMA = (
    "geocell_index bigint, country string, admin1 string, cell_id string, cluster_id bigint, count bigint, "
    "indices string, centroid_lat double, centroid_lng double"
)


def read_prototypes(spark: SparkSession, path: str, schema: str = PROTOTYPE_SCHEMA) -> DataFrame:
    table = spark.read.schema(schema).option("header", "true").csv(path)
    return table.withColumn("indices", parse_indices(F.col("indices")))


def write_prototypes(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write prototype rows; in CSV the id list becomes a bracketed text."""
    if fmt == "csv":
        text = F.concat(F.lit("["), F.array_join(F.col("indices").cast("array<string>"), ", "), F.lit("]"))
        df.withColumn("indices", text).write.option("header", "true").csv(path)
    else:
        df.write.format(fmt).save(path)


def read_country_rates(spark: SparkSession, path: str) -> DataFrame:
    """``country, rate`` lines, split at the last comma, else at the last blank before a number."""
    return parse_country_rates(spark.read.text(path).select(F.col("value").alias("line")))


def parse_country_rates(lines: DataFrame) -> DataFrame:
    text = F.trim("line")
    numbered = r"^(.*?)[,\s]\s*([0-9]*\.?[0-9]+)\s*$"
    country = F.regexp_extract(text, numbered, 1)
    rate = F.regexp_extract(text, numbered, 2).try_cast("double")
    matched = rate.isNotNull()
    name = F.trim(F.regexp_replace(F.when(matched, country).otherwise(text), r",\s*$", ""))
    return lines.where(text != "").select(name.alias("country"), rate.alias("rate"))


def read_boundaries(
    spark: SparkSession,
    folder: str,
    name_candidates: Sequence[str] = K.COUNTRY_COLUMNS,
    pattern: str = "*.{json,geojson}",
) -> DataFrame:
    """Polygon parts of a folder of GeoJSON files.

    One row per part: country, name_1, name_2, part_id, rings (outer ring first) and
    the area of the outer ring.  Files that cannot be read are skipped.  A file
    without a known country column gives the second token of its name.
    """
    shape = (
        "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    )
    raw = (
        spark.read.schema(shape)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", pattern)
        .json(folder)
        .select(F.explode("features").alias("f"), F.col("_metadata.file_name").alias("file"))
    )
    single = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    several = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", single).when(
        F.col("f.geometry.type") == "MultiPolygon", several
    )
    named = F.coalesce(*[F.try_element_at("f.properties", F.lit(c)) for c in name_candidates])
    token = F.try_element_at(F.split(F.regexp_replace("file", r"\.[^.]*$", ""), "_"), F.lit(2))
    vertex = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = F.transform("polygon", lambda ring: F.transform(ring, vertex))
    return (
        raw.select(
            F.coalesce(named, token).alias("country"),
            F.try_element_at("f.properties", F.lit("NAME_1")).alias("name_1"),
            F.try_element_at("f.properties", F.lit("NAME_2")).alias("name_2"),
            F.posexplode(polygons).alias("part_id", "polygon"),
        )
        .withColumn("rings", rings)
        .withColumn("area", ring_area(F.col("rings")[0]))
        .drop("polygon")
    )
