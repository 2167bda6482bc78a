"""Point-in-polygon, nearest and neighbourhood joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions import geometry as G
from geolens.functions.scalar import haversine_km, one_hot, round6, unit_xyz
from geolens.operators.clipped import clipped_join, meeting_pairs
from geolens.operators.grid import grid_join, nearest
from geolens.operators.spread import salted_join, top_per_key
from geolens.session import cut_lineage


def polygon_table(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Replace a ring column by the edge list and box every join here works on."""
    boxes = F.transform(F.col(rings), G.ring_bbox)

    def outer(field: str, pick) -> Column:
        return pick(F.transform(F.col("_boxes"), lambda b: b[field]))

    return (
        df.withColumn("_boxes", boxes)
        .withColumns(
            {
                "edges": G.polygon_edges(F.col(rings)),
                "min_x": outer("min_x", F.array_min),
                "min_y": outer("min_y", F.array_min),
                "max_x": outer("max_x", F.array_max),
                "max_y": outer("max_y", F.array_max),
            }
        )
        .drop("_boxes", rings)
    )



def _box_sides() -> tuple[list[Column], list[Column]]:
    return [F.col("min_x"), F.col("min_y")], [F.col("max_x"), F.col("max_y")]


def join_within(
    points: DataFrame, polygons: DataFrame, label: str, default: str = "UNKNOWN", size: float = 4.0
) -> DataFrame:
    """Left join of points to the polygons strictly containing them.

    A point in several polygons appears once for each; a point in none gets
    ``default``.  ``polygons`` comes from :func:`polygon_table`.
    """
    joined = clipped_join(points, polygons, size, boundary=False, how="left", salt=True)
    return joined.withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def boundary_pieces(polygons: DataFrame, key: str, piece: float) -> DataFrame:
    """Cut polygon edges into pieces no longer than ``piece``, with their midpoints."""
    e = F.col("e")
    edges = polygons.select(key, F.explode("edges").alias("e"))
    steps = F.greatest(F.lit(1), F.ceil(F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]) / F.lit(piece)))
    middle = (F.col("step") - F.lit(0.5)) / F.col("steps")
    return (
        edges.withColumn("steps", steps)
        .withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("steps"))))
        .select(
            key,
            (e["x1"] + (e["x2"] - e["x1"]) * middle).alias("i0"),
            (e["y1"] + (e["y2"] - e["y1"]) * middle).alias("i1"),
            e["x1"].alias("x1"),
            e["y1"].alias("y1"),
            e["x2"].alias("x2"),
            e["y2"].alias("y2"),
        )
    )


def label_covered_or_nearest(
    points: DataFrame, cells: DataFrame, one_hot_size: int | None = None, size: float = 4.0, levels: int = 8
) -> DataFrame:
    """Lowest cell covering the point, boundary included; otherwise the nearest cell.

    The nearest cell is measured to its boundary in degrees, ties to the lower
    index.  Points are reduced to distinct coordinates for the search; a point without
    coordinates has no label.
    """
    lon, lat = F.col("lon"), F.col("lat")
    spots = points.select("lon", "lat").dropna().distinct()
    covered = clipped_join(spots, cells, size, boundary=True)
    covered = cut_lineage(covered.groupBy("lon", "lat").agg(F.min("geocell_index").alias("geocell_index")))
    rest = spots.join(covered, ["lon", "lat"], "left_anti").withColumns({"q0": lon, "q1": lat})
    pieces = boundary_pieces(cells, "geocell_index", size)
    gap = G.segment_distance(lon, lat, *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    closest = nearest(
        rest, pieces, ["lon", "lat"], F.round(gap, 9), [F.col("geocell_index")], 2, size, levels, slack=size / 2
    ).select("lon", "lat", "geocell_index")
    labels = covered.unionByName(closest)
    out = salted_join(points, labels, ["lon", "lat"], "left")
    if one_hot_size is not None:
        out = out.withColumn("one_hot", one_hot(F.col("geocell_index"), one_hot_size))
    return out


def label_bbox(points: DataFrame, cells: DataFrame, size: float = 4.0) -> DataFrame:
    """First cell whose upper-right and lower-left corners enclose the point; 0 if none.

    ``cells`` has geocell_index and a closed ``ring`` listing the upper right corner first.
    """
    boxes = cells.select(
        "geocell_index",
        F.element_at("ring", 1)["x"].alias("max_x"),
        F.element_at("ring", 1)["y"].alias("max_y"),
        F.element_at("ring", 3)["x"].alias("min_x"),
        F.element_at("ring", 3)["y"].alias("min_y"),
    )
    lows, highs = _box_sides()
    lon, lat = F.col("lon"), F.col("lat")
    inside = lon.between(F.col("min_x"), F.col("max_x")) & lat.between(F.col("min_y"), F.col("max_y"))
    spots = points.select("lon", "lat").distinct()
    hits = grid_join(spots, boxes, [lon, lat], lows, highs, size, inside)
    first = hits.groupBy("lon", "lat").agg(F.min("geocell_index").alias("geocell_index"))
    labelled = salted_join(points, first, ["lon", "lat"], "left")
    return labelled.withColumn("geocell_index", F.coalesce("geocell_index", F.lit(0)))


def assign_admin_cell(
    points: DataFrame, adm0: DataFrame, adm1: DataFrame, adm2: DataFrame, size: float = 4.0
) -> DataFrame:
    """Country, then first-level, then second-level region of each point.

    Each level only looks inside the region found before; the first match is the
    one with the lowest ordinal.  Points that miss a level are dropped.
    ``adm0`` has country_id, ``adm1`` country_id and admin1_id, ``adm2`` country_id,
    admin1_id and cell_id, all from :func:`polygon_table`.
    """
    found = points.select("lon", "lat").distinct()
    for table, keys, target in (
        (adm0, [], "country_id"),
        (adm1, ["country_id"], "admin1_id"),
        (adm2, ["country_id", "admin1_id"], "cell_id"),
    ):
        hits = clipped_join(found, table, size, boundary=False, keys=keys)
        found = hits.groupBy("lon", "lat", *keys).agg(F.min(target).alias(target))
    return salted_join(points, found, ["lon", "lat"])


def cell_neighbours(cells: DataFrame, size: float = 8.0) -> DataFrame:
    """Pairs of cells of one country whose shapes meet, in both directions.

    Boxes, diamonds and other octagons meet where their extents do.  Any other cell is clipped to squares, so a pair
    is settled by the edges of the squares it shares.
    """
    pairs = meeting_pairs(cells, "country_id", "cell_id", size)
    src, dst, back = F.col("src"), F.col("dst"), F.col("_back")
    both = pairs.withColumn("_back", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.select("country_id", F.when(back, dst).otherwise(src).alias("src"), F.when(back, src).otherwise(dst).alias("dst"))


def nearest_centroid(
    points: DataFrame, cells: DataFrame, radius_m: float = K.LABEL_RADIUS_M, size: float = 0.08
) -> DataFrame:
    """Class whose centroid has the smallest great-circle distance.

    ``cells`` has geocell_index, clat, clon.  The search runs on the unit sphere,
    where chord length orders pairs as distance does, over distinct coordinates.
    Ties (to the millimetre) go to the lower index; a point without coordinates has no label.
    """
    spots = points.select("lat", "lon").dropna().distinct()
    queries = spots.withColumns({f"q{a}": v for a, v in enumerate(unit_xyz(F.col("lat"), F.col("lon")))})
    items = cells.select("geocell_index", "clat", "clon").withColumns(
        {f"i{a}": v for a, v in enumerate(unit_xyz(F.col("clat"), F.col("clon")))}
    )
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"), radius_m), 6)
    best = nearest(
        queries, items, ["lat", "lon"], km, [F.col("geocell_index")], 3, size, 6, score_name="distance_km"
    ).select("lat", "lon", "geocell_index", "distance_km")
    return salted_join(points, best, ["lat", "lon"], "left")


def coverage_snap(candidates: DataFrame, coverage: DataFrame, radius_m: float = 60.0) -> DataFrame:
    """Covered position nearest to each candidate within ``radius_m``, distinct at six decimals."""
    sites = coverage.select("lat", "lon").distinct()
    best = snap_to_coverage(candidates, sites, radius_m)
    return best.select(round6(F.col("s_lat")).alias("lat"), round6(F.col("s_lon")).alias("lon")).distinct()


def snap_to_coverage(candidates: DataFrame, sites: DataFrame, radius_m: float) -> DataFrame:
    """(lat, lon, s_lat, s_lon, km): each distinct candidate with the nearest of the distinct ``sites`` within reach."""
    reach = radius_m / K.SCORE_RADIUS_M
    spots = candidates.select("lat", "lon").distinct()
    spots = spots.withColumns({f"q{a}": v for a, v in enumerate(unit_xyz(F.col("lat"), F.col("lon")))})
    sites = sites.select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    sites = sites.withColumns({f"i{a}": v for a, v in enumerate(unit_xyz(F.col("s_lat"), F.col("s_lon")))})
    q = [F.col(f"q{a}") for a in range(3)]
    i = [F.col(f"i{a}") for a in range(3)]
    margin = F.lit(reach * 1.001)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    pairs = grid_join(
        spots,
        sites,
        q,
        [v - margin for v in i],
        [v + margin for v in i],
        reach * 3.0,
        km <= F.lit(radius_m / 1000.0),
    ).withColumn("km", km)
    best = top_per_key(pairs, ["lat", "lon"], [F.col("km"), F.col("s_lat"), F.col("s_lon")])
    return best.select("lat", "lon", "s_lat", "s_lon", "km")


def lookup_exact_or_nearest(
    points: DataFrame, table: DataFrame, key: str, size: float = 2.0, levels: int = 8
) -> DataFrame:
    """Row of ``table`` at the point's coordinates, otherwise the closest one in degrees.

    Adds ``key`` and ``exact``; ties go to the smaller key.  Both are NULL for a point without coordinates.
    """
    first = table.groupBy("lat", "lon").agg(F.min(key).alias(key))
    spots = points.select("lat", "lon").dropna().distinct()
    exact = spots.join(first.hint("merge"), ["lat", "lon"]).withColumn("exact", F.lit(True))
    rest = spots.join(first.hint("merge"), ["lat", "lon"], "left_anti").withColumns({"q0": F.col("lon"), "q1": F.col("lat")})
    items = first.select(key, F.col("lon").alias("i0"), F.col("lat").alias("i1"))
    gap = F.pow(F.col("q0") - F.col("i0"), F.lit(2.0)) + F.pow(F.col("q1") - F.col("i1"), F.lit(2.0))
    closest = nearest(rest, items, ["lat", "lon"], F.round(gap, 9), [F.col(key)], 2, size, levels)
    closest = closest.select("lat", "lon", key).withColumn("exact", F.lit(False))
    return salted_join(points, exact.unionByName(closest), ["lat", "lon"], "left")
