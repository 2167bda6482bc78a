"""Image listings, upload records, image and embedding tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions.scalar import fill_optional_columns, location_id
from geolens.operators.spread import top_per_key
from geolens.operators.tables import first_n, nearest_heading


def parse_image_listing(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row per (location, heading) from names ``lat_lon_heading_date_pano.jpg``.

    Names that do not parse are dropped.  Of several images of one heading the last
    name is used; capture date and panorama come from the first name of the location.
    """
    name = F.substring_index(F.col(path), "/", -1)
    bare = F.regexp_extract(name, r"(?i)^(.*)\.jpg$", 1)

    def fields(parts: Column) -> Column:
        def piece(i: int, kind: str) -> Column:
            return F.try_element_at(parts, F.lit(i)).try_cast(kind)

        lat, lon = piece(1, "double"), piece(2, "double")
        return F.struct(
            F.col(path).alias("image_path"),
            name.alias("name"),
            lat.alias("lat"),
            lon.alias("lon"),
            piece(3, "int").alias("heading"),
            piece(4, "string").alias("capture_date"),
            F.when(F.size(parts) > 4, F.array_join(F.slice(parts, F.lit(5), F.size(parts)), "_")).alias("pano_id"),
            F.format_string("%.7f_%.7f", lat, lon).alias("place"),
        )

    def complete(row: Column) -> Column:
        return row["lat"].isNotNull() & row["lon"].isNotNull() & row["heading"].isNotNull() & row["pano_id"].isNotNull()

    # A name is taken apart once: the test on the result stays inside the generator
    # instead of being pushed below it as a second copy of the parsing.
    parsed = paths.select(F.inline(F.filter(F.transform(F.array(F.split(bare, "_")), fields), complete)))
    seen = parsed.groupBy("place", "heading").agg(
        F.max(F.struct("name", "image_path")).alias("last"),
        F.min(F.struct("name", "lat", "lon", "capture_date", "pano_id")).alias("first"),
    )
    # One row per heading is left, so the window over a place is short.
    earliest = F.min("first").over(Window.partitionBy("place"))
    rows = seen.withColumn("f", earliest)
    return rows.select(
        "place",
        "heading",
        F.col("first.name").alias("ord"),
        F.col("last.image_path").alias("image_path"),
        *[F.col(f"f.{c}").alias(c) for c in ("lat", "lon", "capture_date", "pano_id")],
    )


def read_image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Listing of a folder of images; only the file names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][pP][gG]").load(folder)
    return parse_image_listing(files.select("path"))


def image_records(listing: DataFrame, headings: Sequence[int] = K.HEADINGS) -> DataFrame:
    """One upload record per location and wanted heading, with the nearest stored image."""
    keyed = listing.withColumn("location_id", location_id(F.col("lat"), F.col("lon")))
    return nearest_heading(keyed, headings).select(
        "location_id",
        "lat",
        "lon",
        F.pmod("wanted_heading", F.lit(360)).alias("heading"),
        "image_path",
        "capture_date",
        "pano_id",
    )


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("image_path"), F.col("content").alias("image"))


def build_image_table(
    snapshot: DataFrame, images: DataFrame, order: str = "ord", max_rows: int | None = None
) -> DataFrame:
    """Snapshot rows with their image bytes, latest per (location_id, heading), without missing images.

    The key is settled before the bytes are joined, so only kept images are moved.
    """
    keys = ["location_id", "heading"]
    full = fill_optional_columns(snapshot, K.SNAPSHOT_SCHEMA)
    present = full.join(images.where(F.col("image").isNotNull()).select("image_path"), "image_path", "left_semi")
    latest = top_per_key(present, keys, [F.col(order).desc()])
    if max_rows is not None:
        latest = first_n(latest, [F.col(k) for k in keys], max_rows)
    return latest.join(images, "image_path")


# ---- vectors from a caller's model ------------------------------------------


def map_embeddings(
    df: DataFrame,
    load: Callable[[], Callable[[Sequence[bytes]], np.ndarray]],
    batch_size: int,
    out_dim: int,
    image: str = "image",
) -> DataFrame:
    """Add ``embedding`` and ``ok`` by running a caller's model over the images.

    ``load`` is called once per task and returns a function from a list of images to
    a matrix.  A missing image, or one the model cannot take, gets a zero vector and
    ``ok`` false; a failing batch is retried image by image.
    """
    from pyspark.sql import types as T

    schema = T.StructType(
        [*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("ok", T.BooleanType())]
    )

    def embed(model, blobs: list[bytes]) -> list[np.ndarray | None]:
        try:
            return list(np.asarray(model(blobs), dtype=np.float32))
        except Exception:  # noqa: BLE001 - a bad image must not end the job
            return [None] if len(blobs) == 1 else [v for b in blobs for v in embed(model, [b])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size].copy()
                given = [i for i, blob in enumerate(part[image]) if blob is not None]
                vectors: list[np.ndarray | None] = [None] * len(part)
                if given:
                    blobs = part[image].tolist()
                    for i, vector in zip(given, embed(model, [blobs[i] for i in given])):
                        vectors[i] = vector
                part["ok"] = [v is not None for v in vectors]
                part["embedding"] = [np.zeros(out_dim, np.float32) if v is None else v for v in vectors]
                yield part

    return df.mapInPandas(run, schema)


def wide_embeddings(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Spread a vector over the columns emb_0 .. emb_{dim-1}."""
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[F.col(vector)[i].alias(f"emb_{i}") for i in range(dim)])


def build_embedding_table(images: DataFrame, load: Callable, batch_size: int, dim: int, wide: bool = False) -> DataFrame:
    """Snapshot rows with a vector per image; rows whose image could not be embedded are left out."""
    vectors = map_embeddings(images, load, batch_size, dim).where("ok").drop("ok", "image")
    vectors = vectors.withColumn("embedding_dim", F.size("embedding"))
    return wide_embeddings(vectors, dim) if wide else vectors
