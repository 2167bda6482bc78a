"""The geocell build: from points and regions to a prototype table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions.geometry import ring_area, ring_centroid
from geolens.operators import geocells, spatial
from geolens.session import cut_lineage, discard

MEMBERS_AT_ONCE = 1_000_000


def with_shape(regions: DataFrame, rings: str = "rings") -> DataFrame:
    """Area and centroid of the outer ring, for the centroids of merged cells."""
    outer = F.col(rings)[0]
    return regions.withColumns({"area": ring_area(outer), "cx": ring_centroid(outer)["x"], "cy": ring_centroid(outer)["y"]})


def merged_cells(points: DataFrame, adm0: DataFrame, adm1: DataFrame, adm2: DataFrame, min_points: int = K.MIN_CELL_POINTS) -> tuple[DataFrame, DataFrame]:
    """Points with the cell that absorbed theirs, and (cell_id, country_id, admin1_id, lat, lon) of these cells.

    ``adm2`` also has area, cx and cy (:func:`with_shape`); a merged cell's centroid is the mean of its regions'
    centroids by area.  Points outside every region are dropped.
    """
    placed = cut_lineage(spatial.assign_admin_cell(points, adm0, adm1, adm2.drop("area", "cx", "cy")))
    counts = placed.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_points"))
    cells = cut_lineage(adm2.select("cell_id", "country_id", "admin1_id", "area", "cx", "cy").join(counts, "cell_id", "left").fillna(0, ["n_points"]))
    neighbours = cut_lineage(spatial.cell_neighbours(adm2.drop("area", "cx", "cy", "admin1_id")).select("src", "dst"))
    roots = cut_lineage(geocells.merge_sparse_cells(cells.select("cell_id", "n_points"), neighbours, min_points))
    weight = F.sum("area")
    centroids = cells.join(roots, "cell_id").groupBy("root").agg((F.sum(F.col("area") * F.col("cy")) / weight).alias("lat"), (F.sum(F.col("area") * F.col("cx")) / weight).alias("lon"))
    names = cells.select(F.col("cell_id").alias("root"), "country_id", "admin1_id")
    whole = cut_lineage(names.join(centroids, "root").withColumnRenamed("root", "cell_id"))
    owners = roots.join(names, "root").select("cell_id", "root", F.col("country_id").alias("_country"), F.col("admin1_id").alias("_admin1"))
    # A region is one row of ``owners``; where it holds a large part of all points, adaptive execution splits its side.
    moved = placed.join(owners, "cell_id").withColumns({"cell_id": F.col("root"), "country_id": F.col("_country"), "admin1_id": F.col("_admin1")})
    out = cut_lineage(moved.drop("root", "_country", "_admin1"))
    discard(placed, cells, neighbours, roots)
    return out, whole


def clustered_cells(
    points: DataFrame,
    eps: float | None = None,
    tight_eps: float | None = None,
    max_points: int = K.MAX_CELL_POINTS,
    min_cluster: int = K.MAX_CLUSTER_POINTS,
    min_points: int = K.CLUSTER_MIN_POINTS,
) -> DataFrame:
    """Clusters of each cell in two radii.

    Large clusters of crowded cells become cells ``parent_cluster`` and are clustered again with ``tight_eps``.  Every
    row keeps its way: ``parent_id``, ``parent_cluster``, and ``cluster_id`` inside its own ``cell_id``.
    """
    first = cut_lineage(geocells.density_clusters(points, eps, min_points))
    first_level = first.withColumns({"parent_id": F.col("cell_id").cast("string"), "parent_cluster": F.col("cluster_id")})
    out = cut_lineage(geocells.split_and_cluster(first_level, max_points, min_cluster, tight_eps, min_points).drop("split"))
    discard(first)
    return out


def closed_members(members: DataFrame, at_once: int = MEMBERS_AT_ONCE) -> DataFrame:
    """Chunked member lists put into one sorted list per (geocell_index, cluster_id).

    A prototype of more than ``at_once`` members keeps its chunks, for one value must fit into one task.
    """
    group = ["geocell_index", "cluster_id"]
    sized = members.groupBy(*group).agg(F.sum(F.size("indices")).alias("_members"))
    marked = members.join(sized, group).withColumn("chunk", F.when(F.col("_members") <= at_once, F.lit(0)).otherwise(F.col("chunk")).cast("bigint"))
    # Lists of one prototype come from consecutive ranks, so their smallest ids put them in order.
    lists = F.array_sort(F.collect_list("indices"))
    return marked.groupBy(*group, "chunk").agg(F.flatten(lists).alias("indices"))


def geocell_prototypes(clustered: DataFrame, shapes: DataFrame, at_once: int = MEMBERS_AT_ONCE) -> DataFrame:
    """One row per (geocell_index, cluster_id) with its members (more only beyond ``at_once`` of them).

    ``clustered`` has country, admin1, cell_id, cluster_id and the columns of :func:`clustered_cells`.  A cell with a
    shape has that shape's centroid, a split-off one the mean of its points.
    """
    table = geocells.prototype_table(clustered, shapes.withColumn("cell_id", F.col("cell_id").cast("string")))
    lists = closed_members(geocells.prototype_members(clustered), at_once)
    parents = clustered.groupBy("country", "admin1", "cell_id").agg(F.first("parent_id").alias("parent_id"))
    rows = table.join(parents, ["country", "admin1", "cell_id"]).join(lists, ["geocell_index", "cluster_id"])
    return rows.select(
        "geocell_index", "country", "admin1", "cell_id", "parent_id", "cluster_id", "count", "indices", "centroid_lat", "centroid_lng"
    )


def build_geocells(
    points: DataFrame,
    adm0: DataFrame,
    adm1: DataFrame,
    adm2: DataFrame,
    eps: float | None = None,
    tight_eps: float | None = None,
    min_cell: int = K.MIN_CELL_POINTS,
    max_points: int = K.MAX_CELL_POINTS,
    min_cluster: int = K.MAX_CLUSTER_POINTS,
    min_points: int = K.CLUSTER_MIN_POINTS,
) -> DataFrame:
    """Points into regions, sparse regions merged, clusters, crowded cells split, prototypes.

    ``points`` has point_id, lat and lon.  Country and first-level region of a cell are those of the region that absorbed
    the others.  Everything is keyed by cell, so all countries are built in one job.
    """
    merged, shapes = merged_cells(points, adm0, adm1, adm2, min_cell)
    clustered = clustered_cells(merged, eps, tight_eps, max_points, min_cluster, min_points)
    named = clustered.withColumnsRenamed({"country_id": "country", "admin1_id": "admin1"})
    return geocell_prototypes(named, shapes.select("cell_id", "lat", "lon"))
