"""Filters, ordered picks, splits, set operations and lookups on plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions.scalar import _literal_map, heading_distance, round6
from geolens.operators.spread import global_index, rank_in_group, running_total, top_per_key
from geolens.session import range_tasks

# ---- filters ----------------------------------------------------------------


def filter_countries(df: DataFrame, names: DataFrame, candidates: Sequence[str] = K.COUNTRY_COLUMNS) -> DataFrame:
    """Rows whose country is listed in ``names(name)``, ignoring case and outer blanks."""
    column = next((c for c in candidates if c in df.columns), None)
    if column is None:
        raise ValueError(f"no country column among {list(candidates)}")
    wanted = names.select(F.lower(F.trim("name")).alias("_country")).distinct()
    keyed = df.withColumn("_country", F.lower(F.trim(F.col(column).cast("string"))))
    return keyed.join(wanted, "_country", "left_semi").drop("_country")


def complete_panoramas(df: DataFrame, key: str, order: Sequence[Column], tiles: int = 4) -> DataFrame:
    """The first ``tiles`` rows of every group that has that many.

    Rows beyond the first ``tiles`` are dropped before the shuffle, so counting
    what is left of a group needs neither a second shuffle nor a large window.
    """
    first = top_per_key(df, [key], order, tiles, rank="tile")
    left = F.count(F.lit(1)).over(Window.partitionBy(key))
    return first.withColumn("_left", left).where(F.col("_left") == tiles).drop("_left")


def drop_missing_images(df: DataFrame, image: str = "image") -> DataFrame:
    return df.where(F.col(image).isNotNull())


def existing_files(df: DataFrame, listing: DataFrame, on: str) -> DataFrame:
    return df.join(listing.select(on).distinct(), on, "left_semi")


def valid_indices(df: DataFrame, points: DataFrame) -> DataFrame:
    """Member rows whose index exists and whose coordinates are finite numbers."""

    def finite(name: str) -> Column:
        c = F.col(name)
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    good = points.where(finite("lat") & finite("lon"))
    return df.join(good, "point_idx")


def snapshot_metadata(df: DataFrame) -> DataFrame:
    return df.drop("heading", "batch_date")


# ---- snapshots --------------------------------------------------------------


def nearest_heading(images: DataFrame, headings: Sequence[int] = K.HEADINGS) -> DataFrame:
    """For each location and wanted heading the image turned the least away; ties to the first stored."""
    wanted = F.explode(F.array(*[F.lit(h) for h in headings]))
    turned = images.withColumn("wanted_heading", wanted)
    turned = turned.withColumn("turn", heading_distance(F.col("heading"), F.col("wanted_heading")))
    return top_per_key(turned, ["location_id", "wanted_heading"], [F.col("turn"), F.col("ord")])


def merge_latest_wins(
    previous: DataFrame | None, batch: DataFrame, keys: Sequence[str] = ("location_id", "heading"), order: str = "ord"
) -> DataFrame:
    """Previous rows and the batch, newest row per key; without previous rows the batch itself."""
    if previous is None or previous.isEmpty():
        return batch
    both = previous.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = top_per_key(both, keys, [F.col("_new").desc(), F.col(order).desc()]).drop("_new")
    return latest.select(*sorted(latest.columns))


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order)


def build_panoramas(images: DataFrame) -> DataFrame:
    """One row per location: headings and images by heading, position of the first.

    Headings are whole degrees and a snapshot holds one row for each, so a
    location gathers at most 360 rows; repeats are removed first.
    """
    one = top_per_key(
        images.withColumn("heading", F.pmod("heading", F.lit(360))), ["location_id", "heading"], [F.col("ord").desc()]
    )
    views = F.array_sort(F.collect_list(F.struct("heading", "image", "lat", "lon")))
    return (
        one.groupBy("location_id")
        .agg(views.alias("v"))
        .select(
            "location_id",
            F.col("v")[0]["lat"].alias("lat"),
            F.col("v")[0]["lon"].alias("lon"),
            F.transform("v", lambda s: s["heading"]).alias("headings"),
            F.transform("v", lambda s: s["image"]).alias("images"),
        )
    )


def ingest_report(batch: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows in the batch, rows and distinct locations in the latest snapshot."""
    places = latest.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))
    parts = batch.agg(F.count(F.lit(1)).alias("rows_in_batch")).unionByName(
        places.agg(F.sum("n").alias("rows_in_latest"), F.count(F.lit(1)).alias("distinct_locations")),
        allowMissingColumns=True,
    )
    names = ("rows_in_batch", "rows_in_latest", "distinct_locations")
    return parts.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])


# ---- splits, indexes and batches --------------------------------------------


def split_ordered(df: DataFrame, order: Sequence[Column], frac: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """First int(frac*n) rows of an order, and the rest."""
    indexed = global_index(df, order, "_at")
    cut = int(frac * indexed.count())
    return indexed.where(F.col("_at") < cut).drop("_at"), indexed.where(F.col("_at") >= cut).drop("_at")


def split_stratified(
    df: DataFrame, stratum: str, key: str, frac: float = 0.1, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows, shuffled per stratum by a seeded hash.

    Every stratum sends max(1, int(n*frac)) rows to validation, so a single row goes there.
    Rows without a stratum are a stratum of their own.
    """
    mixed = df.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    ranked = rank_in_group(mixed, [stratum], [F.col("_mix"), F.col(key)], "_at")
    size = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * frac))
    sizes = df.groupBy(F.col(stratum).alias("_stratum")).agg(size.alias("_val"))
    marked = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")))
    drop = ("_mix", "_at", "_val", "_stratum")
    return (
        marked.where(F.col("_at") > F.col("_val")).drop(*drop),
        marked.where(F.col("_at") <= F.col("_val")).drop(*drop),
    )


def allocate_by_area(parts: DataFrame, need: int | str, scalar: float = 1.0) -> DataFrame:
    """Points each polygon part of a country takes, in part order, never beyond the country's need.

    ``need`` is a number or a column of ``parts``.  Parts without a country are one country; parts of a country
    without area take nothing and are left out.
    """
    totals = parts.groupBy(F.col("country").alias("_country")).agg(F.sum("area").alias("_total")).where(F.col("_total") > 0)
    wanted = F.col(need) if isinstance(need, str) else F.lit(need)
    sized = parts.join(totals, F.col("country").eqNullSafe(F.col("_country"))).drop("_country")
    sized = sized.withColumn("_need", wanted.cast("bigint"))
    sized = sized.withColumn("_r", F.rint(F.col("area") * scalar / F.col("_total") * F.col("_need")).cast("bigint"))
    summed = running_total(sized, ["country"], [F.col("part_id")], F.col("_r"), "_cum")
    take = F.least("_cum", "_need") - F.least(F.col("_cum") - F.col("_r"), F.col("_need"))
    return summed.withColumn("take", take).drop("_total", "_need", "_r", "_cum")


def geocell_index(cells: DataFrame) -> DataFrame:
    """Dense index of the distinct (country, admin1, cell_id) keys in sorted order."""
    keys = ["country", "admin1", "cell_id"]
    return global_index(cells.select(*keys).distinct(), [F.col(k) for k in keys], "geocell_index")


def label_map(df: DataFrame, column: str) -> DataFrame:
    """Class names in sorted order with their number."""
    names = df.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct()
    return global_index(names, [F.col("name")], "label_id")


def apply_label_map(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Number the classes of ``column``; a class not in the map gets UNKNOWN and the next free number."""
    unknown = labels.count()
    known = labels.select(F.col("name").alias(column), "label_id")
    out = df.join(known, column, "left")
    return out.withColumns(
        {
            "class_name": F.when(F.col("label_id").isNull(), F.lit("UNKNOWN")).otherwise(F.col(column)),
            "label_id": F.coalesce("label_id", F.lit(unknown)),
        }
    )


def batch_number(df: DataFrame, order: Sequence[Column], size: int = K.COLLECTION_BATCH) -> DataFrame:
    indexed = global_index(df, order, "_at")
    return indexed.withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def version_nth(keys: DataFrame, n: int = 0) -> DataFrame:
    """The n-th newest version id found in a listing of object keys (0 is the newest)."""
    ids = keys.select(F.regexp_extract("key", r"run_ts=([^/]+)", 1).alias("version")).where("version <> ''")
    newest = ids.distinct().orderBy(F.col("version").desc())
    picked = newest.limit(n + 1).orderBy("version").limit(1) if n >= 0 else newest.limit(0)
    total = ids.distinct().count()
    if not 0 <= n < total:
        raise IndexError(f"version {n} of {total}")
    return picked


# ---- ordered picks ----------------------------------------------------------


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order, for any ``n``.

    Rows are numbered inside buckets of input partitions; of a bucket at most ``n`` rows can be among the first,
    which for a small ``n`` drops nearly all of them before the shuffle.  What is left is cut by its place in the
    order, so no task holds more than a range of it.
    """
    bucket = F.pmod(F.spark_partition_id(), F.lit(range_tasks(df.sparkSession)))
    left = top_per_key(df.withColumn("_bucket", bucket), ["_bucket"], order, n).drop("_bucket")
    return global_index(left, order, "_at").where(F.col("_at") < n).orderBy("_at").drop("_at")


def collection_budget(points: DataFrame, n: int) -> DataFrame:
    return first_n(points, [F.col("lat"), F.col("lon")], n)


def rank_cells(stats: DataFrame, count: str = "n_points", key: str = "cell_id") -> DataFrame:
    return stats.orderBy(F.col(count).desc(), F.col(key))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by a seeded hash of ``key``."""
    mix = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return first_n(df, [mix, F.col(key)], n)


def random_panorama(images: DataFrame, seed: int = 42, tiles: int = 4) -> DataFrame:
    """The tiles of one complete location, chosen by a seeded hash."""
    full = complete_panoramas(images, "location_id", [F.col("heading"), F.col("ord")], tiles)
    chosen = sample_n(full.where(F.col("tile") == tiles).select("location_id"), "location_id", 1, seed)
    return full.join(chosen, "location_id", "left_semi")


# ---- sets -------------------------------------------------------------------


def union_dedupe(a: DataFrame, b: DataFrame, order: str = "ord") -> DataFrame:
    """Both point lists; of points equal at six decimals the first one stays as it was."""
    both = a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1)))
    both = both.withColumns({"_lat": round6(F.col("lat")), "_lon": round6(F.col("lon"))})
    return top_per_key(both, ["_lat", "_lon"], [F.col("_src"), F.col(order)]).drop("_lat", "_lon")


def point_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct points of ``a`` that are not in ``b``, compared as exact numbers."""
    return a.select("lat", "lon").subtract(b.select("lat", "lon"))


def distinct_points(a: DataFrame) -> DataFrame:
    return a.select("lat", "lon").distinct()


def collection_plan(
    first: DataFrame, second: DataFrame, collected: DataFrame, failed: DataFrame, n: int
) -> DataFrame:
    """Points still to be collected, within budget, in numbered batches."""
    open_points = union_dedupe(first, second)
    done = collected.select("lat", "lon").unionByName(failed.select("lat", "lon"))
    picked = collection_budget(point_difference(open_points, done), n)
    return batch_number(picked, [F.col("lat"), F.col("lon")])


# ---- lookups ----------------------------------------------------------------


def point_cell_info(points: DataFrame, cell_points: DataFrame) -> DataFrame:
    """Country, region, cell and cluster stored for the exact coordinates; the last entry wins."""
    last = top_per_key(cell_points, ["lat", "lon"], [F.col("ord").desc()]).select(
        "lat", "lon", "country", "admin1", "geocell", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id")
    )
    return points.join(last, ["lat", "lon"], "left")


def raster_sample(
    points: DataFrame,
    raster: DataFrame,
    origin: tuple[float, float],
    pixel: tuple[float, float],
    legend: dict | None = None,
    name: str = "climate",
) -> DataFrame:
    """Raster value under each point; NULL outside the raster or without a legend entry.

    ``origin`` is the upper left corner (lon, lat), ``pixel`` the pixel width and height.
    """
    (x0, y0), (dx, dy) = origin, pixel
    keyed = points.withColumns(
        {
            "row": F.floor((F.lit(y0) - F.col("lat")) / dy).cast("int"),
            "col": F.floor((F.col("lon") - F.lit(x0)) / dx).cast("int"),
        }
    )
    hit = keyed.join(raster.select("row", "col", F.col("value").alias("_v")), ["row", "col"], "left")
    value = F.col("_v") if legend is None else F.try_element_at(_literal_map(legend), F.col("_v").cast("int"))
    return hit.withColumn(name, value).drop("row", "col", "_v")


def geocell_meta(df: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Country and region of a cell index, from the first prototype row; ``?`` when unknown."""
    first = top_per_key(prototypes, ["geocell_index"], [F.col("ord")]).select("geocell_index", "country", "admin1")
    out = df.join(first, "geocell_index", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("?")) for c in ("country", "admin1")})


def attach_by_index(prototypes: DataFrame, members: DataFrame) -> DataFrame:
    """Member rows behind the index lists of the prototypes."""
    listed = prototypes.withColumn("point_idx", F.explode("indices")).drop("indices")
    return listed.join(members, "point_idx")


def restore_order_join(rows: DataFrame, embeddings: DataFrame, n: int) -> DataFrame:
    """Bring gathered embeddings back to their rows; padding and repeats are dropped."""
    kept = top_per_key(embeddings.where(F.col("row_id") < n), ["row_id"], [F.col("ord")]).drop("ord")
    return rows.join(kept, "row_id")


def country_rate_join(counts: DataFrame, rates: DataFrame) -> DataFrame:
    return counts.join(rates, "country", "left")
