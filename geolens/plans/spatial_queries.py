"""Queries over polygons, neighbours, geocell building and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions.geometry import box_ring
from geolens.operators import build, geocells, measures, sampling, spatial, tables
from geolens.plans.scalar_queries import n4
from geolens.plans.views import Tables, haversine, oracle, r4
from geolens.session import cut_lineage, range_tasks, work_path
from geolens.sources.text import PROTOTYPE_SCHEMA, read_boundaries, read_prototypes, write_prototypes

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return add


def box_rings(df: DataFrame) -> DataFrame:
    return df.withColumn("ring", box_ring(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]))


def box_polygons(df: DataFrame) -> DataFrame:
    ringed = box_rings(df.drop("clat", "clon")).withColumn("rings", F.array("ring")).drop("ring", "min_x", "min_y", "max_x", "max_y")
    return spatial.polygon_table(ringed)


def diamond_polygons(t: Tables) -> DataFrame:
    x, y = F.col("clon"), F.col("clat")
    corners = [(x - 36, y), (x, y - 18), (x + 36, y), (x, y + 18), (x - 36, y)]
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])
    return spatial.polygon_table(t.cells.select("geocell_index", F.array(ring).alias("rings")))


# ---- containment -------------------------------------------------------------


@query(
    "SELECT point_id, coalesce('cell ' || geocell_index, 'UNKNOWN') AS cell FROM @loc_points LEFT JOIN @cells "
    "ON abs(lon - clon)/36.0@D + abs(lat - clat)/18.0@D < 1"
)
def join_within(t: Tables) -> DataFrame:
    named = diamond_polygons(t).withColumn("cell", F.concat(F.lit("cell "), F.col("geocell_index").cast("string")))
    return spatial.join_within(t.loc_points, named.drop("geocell_index"), "cell").select("point_id", "cell")


_CLIP = "greatest(0.0@D, least(1.0@D, ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/(pow(x2-x1,2)+pow(y2-y1,2))))"
_SEGMENTS = (
    "SELECT geocell_index, clon-36 AS x1, clat AS y1, clon AS x2, clat-18 AS y2 FROM @cells UNION ALL "
    "SELECT geocell_index, clon, clat-18, clon+36, clat FROM @cells UNION ALL SELECT geocell_index, clon+36, clat, clon, clat+18 FROM @cells "
    "UNION ALL SELECT geocell_index, clon, clat+18, clon-36, clat FROM @cells"
)


@query(
    "WITH c AS (SELECT point_id, min(geocell_index) AS g FROM @loc_points JOIN @cells ON abs(lon - clon)/36.0@D + abs(lat - clat)/18.0@D <= 1 GROUP BY 1), "
    f"d AS (SELECT point_id, geocell_index, x1, y1, x2, y2, lon, lat, {_CLIP} AS f FROM @loc_points, ({_SEGMENTS}) s WHERE point_id NOT IN (SELECT point_id FROM c)), "
    "n AS (SELECT point_id, geocell_index, min(round(sqrt(pow(lon-(x1+f*(x2-x1)),2)+pow(lat-(y1+f*(y2-y1)),2)), 9)) AS km FROM d GROUP BY 1, 2), "
    "b AS (SELECT point_id, geocell_index AS g FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, geocell_index) AS r FROM n) x WHERE r = 1) "
    "SELECT point_id, g AS geocell_index, array_to_string([CASE WHEN i = g THEN 1 ELSE 0 END FOR i IN range(25)], '') AS one_hot FROM (SELECT * FROM c UNION ALL SELECT * FROM b) y"
)
def label_covered_or_nearest(t: Tables) -> DataFrame:
    out = spatial.label_covered_or_nearest(t.loc_points, diamond_polygons(t), one_hot_size=25)
    return out.select(
        "point_id", "geocell_index", F.array_join(F.col("one_hot").cast("array<string>"), "").alias("one_hot")
    )


@query(
    "SELECT point_id, coalesce(min(geocell_index), 0) AS geocell_index FROM @loc_points LEFT JOIN (SELECT * FROM @boxes WHERE admin0 <> 2) b "
    "ON lon BETWEEN min_x AND max_x AND lat BETWEEN min_y AND max_y GROUP BY 1"
)
def label_bbox(t: Tables) -> DataFrame:
    cells = box_rings(t.boxes.where("admin0 <> 2"))
    return spatial.label_bbox(t.loc_points, cells).select("point_id", "geocell_index")


def admin_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    strips = t.boxes.groupBy(F.col("admin0").alias("country_id")).agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")
    )
    adm1 = t.boxes.select(
        F.col("admin0").alias("country_id"), F.col("geocell_index").alias("admin1_id"), "min_x", "min_y", "max_x", "max_y"
    )
    return box_polygons(strips), box_polygons(adm1.where("admin1_id <> 7")), box_polygons(t.admin2)


@query(
    "SELECT point_id, country_id, admin1_id, cell_id FROM (SELECT point_id, lon, lat FROM @loc_points) p JOIN @admin2 ON lon > min_x AND lon < max_x AND lat > min_y AND lat < max_y "
    "WHERE admin1_id <> 7"
)
def assign_admin_cell(t: Tables) -> DataFrame:
    """Region 7 has no first-level polygon, so its points drop out."""
    points = t.loc_points.drop("country_id")
    return spatial.assign_admin_cell(points, *admin_tables(t)).select("point_id", "country_id", "admin1_id", "cell_id")


@query(
    "SELECT a.country_id, a.cell_id AS src, b.cell_id AS dst FROM @admin2 a JOIN @admin2 b ON a.country_id = b.country_id AND a.cell_id <> b.cell_id "
    "AND a.max_x >= b.min_x AND b.max_x >= a.min_x AND a.max_y >= b.min_y AND b.max_y >= a.min_y"
)
def cell_neighbours(t: Tables) -> DataFrame:
    return spatial.cell_neighbours(box_polygons(t.admin2))


@query(
    "SELECT a.point_id AS src, b.point_id AS dst, a.country_id FROM @kites a JOIN @kites b ON a.country_id = b.country_id AND a.point_id <> b.point_id "
    "AND abs(a.lon - b.lon) + abs(a.lat - b.lat) <= a.r + b.r"
)
def diamond_neighbours(t: Tables) -> DataFrame:
    """Diamonds around every point: they meet when their centres are within the sum of the radii (in the sum norm)."""
    x, y, r = F.col("lon"), F.col("lat"), F.col("r")
    corners = [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])
    # A table of points is a small file, which few tasks read; outlines are written in many.
    kites = t.kites.repartition(range_tasks(t.spark), "point_id")
    cells = kites.select(F.col("point_id").alias("cell_id"), "country_id", F.array(ring).alias("rings"))
    return spatial.cell_neighbours(spatial.polygon_table(cells), size=4.0)


# ---- nearest -----------------------------------------------------------------


def _nearest_sql(extra: str) -> str:
    km = haversine("lat", "lon", "clat", "clon", K.LABEL_RADIUS_M)
    return (
        f"SELECT {extra} FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, geocell_index) AS n FROM "
        f"(SELECT p.point_id, c.geocell_index, round({km}, 6) AS km FROM @loc_points p, @cells c) x) y WHERE n = 1"
    )


@query(_nearest_sql("point_id, geocell_index, " + r4("km") + " AS distance_km"))
def nearest_centroid(t: Tables) -> DataFrame:
    out = spatial.nearest_centroid(t.loc_points, t.cells)
    return out.select("point_id", "geocell_index", n4("distance_km").alias("distance_km"))


@query(
    "SELECT DISTINCT lat, lon FROM (SELECT round_even(s.lat*1e6::DOUBLE,0)/1e6::DOUBLE AS lat, round_even(s.lon*1e6::DOUBLE,0)/1e6::DOUBLE AS lon, row_number() OVER (PARTITION BY p.point_id ORDER BY "
    + haversine("p.lat", "p.lon", "s.lat", "s.lon", K.SCORE_RADIUS_M)
    + ", s.lat, s.lon) AS n FROM @loc_points p JOIN @coverage s ON abs(p.lat - s.lat) < 0.02 AND "
    + haversine("p.lat", "p.lon", "s.lat", "s.lon", K.SCORE_RADIUS_M)
    + " <= 0.06) x WHERE n = 1"
)
def coverage_snap(t: Tables) -> DataFrame:
    return spatial.coverage_snap(t.loc_points, t.coverage)


@query(
    "WITH k AS (SELECT point_id AS key, lat, lon FROM @loc_points WHERE country_id < 15), "
    "d AS (SELECT p.point_id, k.key, round(pow(p.lon-k.lon,2)+pow(p.lat-k.lat,2), 9) AS g, p.lat = k.lat AND p.lon = k.lon AS exact FROM @loc_points p, k) "
    "SELECT point_id, key, exact FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY g, key) AS n FROM d) x WHERE n = 1"
)
def lookup_exact_or_nearest(t: Tables) -> DataFrame:
    """The table knows the points of fifteen countries; the others fall back to their nearest row."""
    table = t.loc_points.where("country_id < 15").select(F.col("point_id").alias("key"), "lat", "lon")
    return spatial.lookup_exact_or_nearest(t.loc_points, table, "key").select("point_id", "key", "exact")


# ---- cell statistics ---------------------------------------------------------

_STATS = (
    f"count(*) AS n_points, {r4('avg(lat)')} AS mean_lat, {r4('avg(lon)')} AS mean_lon, min(lat) AS min_lat, max(lat) AS max_lat, "
    f"min(lon) AS min_lon, max(lon) AS max_lon, {r4('(max(lat)-min(lat))*(max(lon)-min(lon))')} AS area"
)
_STAT_COLUMNS = ("n_points", "mean_lat", "mean_lon", "min_lat", "max_lat", "min_lon", "max_lon", "area")


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[n4(c).alias(c) if c in ("mean_lat", "mean_lon", "area") else c for c in _STAT_COLUMNS])


@query(f"SELECT cell_id, {_STATS} FROM @point_cells GROUP BY 1")
def cell_stats(t: Tables) -> DataFrame:
    return _rounded(measures.cell_stats(t.point_cells, ["cell_id"]), "cell_id")


@query(f"SELECT country, admin1, {_STATS} FROM (SELECT *, country_id % 5 AS country, country_id AS admin1 FROM @loc_points) p GROUP BY ROLLUP (country, admin1)")
def cell_stats_rollup(t: Tables) -> DataFrame:
    keyed = t.loc_points.withColumns({"country": F.col("country_id") % 5, "admin1": F.col("country_id")})
    return _rounded(measures.cell_stats(keyed, ["country", "admin1"], rollup=True), "country", "admin1")


# ---- geocells ----------------------------------------------------------------


@query(
    "WITH RECURSIVE r AS (SELECT point_id, lat, lon, '' AS cell, false AS done FROM @loc_points UNION ALL "
    "SELECT point_id, lat, lon, CASE WHEN stop THEN cell ELSE cell || CASE WHEN x1 - x0 > y1 - y0 THEN CASE WHEN lon > (x1 + x0)/2 THEN '1' ELSE '0' END "
    "ELSE CASE WHEN lat > (y1 + y0)/2 THEN '1' ELSE '0' END END END, stop FROM (SELECT *, n <= 60 OR (x0 = x1 AND y0 = y1) AS stop FROM (SELECT *, count(*) OVER w AS n, "
    "min(lat) OVER w AS y0, max(lat) OVER w AS y1, min(lon) OVER w AS x0, max(lon) OVER w AS x1 FROM r WHERE NOT done WINDOW w AS (PARTITION BY cell)) a) b) "
    "SELECT cell, count(*) AS n_points, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM r WHERE done GROUP BY 1"
)
def rect_partition(t: Tables) -> DataFrame:
    return geocells.rect_partition(t.loc_points, 60).select(
        "cell", "n_points", "min_lat", "max_lat", "min_lon", "max_lon"
    )


@query(
    "WITH RECURSIVE hits AS (SELECT cell_id, count(*) AS n FROM (SELECT lon, lat FROM @loc_points) p JOIN @admin2 ON lon > min_x AND lon < max_x AND lat > min_y AND lat < max_y "
    "WHERE admin1_id <> 7 GROUP BY 1), "
    "pairs AS (SELECT a.cell_id AS src, b.cell_id AS dst FROM @admin2 a JOIN @admin2 b ON a.country_id = b.country_id AND a.cell_id <> b.cell_id "
    "AND a.max_x >= b.min_x AND b.max_x >= a.min_x AND a.max_y >= b.min_y AND b.max_y >= a.min_y), "
    "reached(cell_id, other) AS (SELECT cell_id, cell_id FROM @admin2 UNION SELECT r.cell_id, p.dst FROM reached r JOIN pairs p ON p.src = r.other), "
    "placed AS (SELECT cell_id, min(other) AS component FROM reached GROUP BY 1) "
    "SELECT component, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_points, count(*) AS n_cells, true AS settled FROM placed LEFT JOIN hits USING (cell_id) GROUP BY 1"
)
def merge_sparse_cells(t: Tables) -> DataFrame:
    """Quarter cells with fewer than 15 points absorb neighbours; totals per group of neighbours.

    Which cells join depends on hashes; that no point or cell is lost, and that every
    root has its points unless it used up its group (``settled``), does not.
    """
    points = t.loc_points.drop("country_id")
    placed = spatial.assign_admin_cell(points, *admin_tables(t))
    counts = placed.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_points"))
    cells = cut_lineage(t.admin2.select("cell_id").join(counts, "cell_id", "left").fillna(0, ["n_points"]))
    neighbours = cut_lineage(spatial.cell_neighbours(box_polygons(t.admin2)).select("src", "dst"))
    merged = geocells.merge_sparse_cells(cells, neighbours, 15)
    roots = merged.join(cells, "cell_id").groupBy("root").agg(
        F.sum("n_points").alias("n_points"), F.count(F.lit(1)).alias("n_cells")
    )
    groups = geocells.connected_components(neighbours).select(F.col("node").alias("root"), F.col("root").alias("group"))
    grouped = roots.join(groups, "root", "left").groupBy(F.coalesce("group", "root").alias("component"))
    return grouped.agg(
        F.sum("n_points").alias("n_points"),
        F.sum("n_cells").alias("n_cells"),
        ((F.min("n_points") >= 15) | (F.count(F.lit(1)) == 1)).alias("settled"),
    )


_GAP = "sqrt((a.lat-b.lat)*(a.lat-b.lat) + (a.lon-b.lon)*(a.lon-b.lon))"
_CORE = (
    f"SELECT cell_id, point_id, nth_value(gap, 5) OVER (PARTITION BY cell_id, point_id ORDER BY gap ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS core, "
    f"row_number() OVER (PARTITION BY cell_id, point_id ORDER BY gap) AS n FROM (SELECT a.cell_id, a.point_id, {_GAP} AS gap FROM @point_cells a JOIN @point_cells b ON a.cell_id = b.cell_id) g"
)


@query(f"SELECT cell_id, point_id, {r4('core')} AS core FROM ({_CORE}) c WHERE n = 1")
def core_distance(t: Tables) -> DataFrame:
    out = geocells.core_distance(t.point_cells, 5, "core")
    return out.select("cell_id", "point_id", n4("core").alias("core"))


def _cluster_steps(eps: str, points: str = "@point_cells", n: str = "") -> str:
    """Steps up to ``clusters`` for a table of points; ``n`` tells several such chains apart."""
    return (
        f"eps{n} AS ({eps}), "
        f"near{n} AS (SELECT a.cell_id, a.point_id AS a, b.point_id AS b FROM {points} a JOIN {points} b ON a.cell_id = b.cell_id JOIN eps{n} e ON e.cell_id = a.cell_id WHERE {_GAP} <= e.eps), "
        f"core{n} AS (SELECT a AS id FROM near{n} GROUP BY 1 HAVING count(*) >= 5), "
        f"link{n} AS (SELECT a, b FROM near{n} WHERE a IN (SELECT id FROM core{n}) AND b IN (SELECT id FROM core{n})), "
        f"reach{n} AS (SELECT id AS a, id AS b FROM core{n} UNION SELECT r.a, l.b FROM reach{n} r JOIN link{n} l ON l.a = r.b), "
        f"roots{n} AS (SELECT a AS id, min(b) AS root FROM reach{n} GROUP BY 1), "
        f"rooted{n} AS (SELECT p.cell_id, p.point_id, coalesce(min(r.root), min(q.root)) AS root FROM {points} p LEFT JOIN roots{n} r ON r.id = p.point_id "
        f"LEFT JOIN near{n} n ON n.a = p.point_id LEFT JOIN roots{n} q ON q.id = n.b GROUP BY 1, 2), "
        f"clusters{n} AS (SELECT cell_id, point_id, CASE WHEN root IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY cell_id ORDER BY root NULLS LAST) - 1 END AS cluster_id FROM rooted{n}) "
    )


def _cluster_ctes(eps: str) -> str:
    return "WITH RECURSIVE " + _cluster_steps(eps)


@query(
    _cluster_ctes(f"SELECT cell_id, median(core) AS eps FROM ({_CORE}) c WHERE n = 1 GROUP BY 1")
    + "SELECT cell_id, point_id, cluster_id FROM clusters"
)
def density_clusters(t: Tables) -> DataFrame:
    return geocells.density_clusters(t.point_cells).select("cell_id", "point_id", "cluster_id")


_FIXED = "SELECT DISTINCT cell_id, 25.0::DOUBLE AS eps FROM @point_cells"


@query(_cluster_ctes(_FIXED) + "SELECT cell_id, point_id, cluster_id FROM clusters")
def density_clusters_fixed_radius(t: Tables) -> DataFrame:
    return geocells.density_clusters(t.point_cells, eps=25.0).select("cell_id", "point_id", "cluster_id")


_SPLIT = (
    "splits AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY cell_id) > 50 AND count(*) OVER (PARTITION BY cell_id, cluster_id) > 10 "
    "THEN concat(cell_id, '_', cluster_id) ELSE CAST(cell_id AS VARCHAR) END AS new_cell FROM clusters) "
)


@query(_cluster_ctes(_FIXED) + ", " + _SPLIT + "SELECT point_id, new_cell AS cell_id, cluster_id FROM splits")
def split_dense_cells(t: Tables) -> DataFrame:
    clustered = geocells.density_clusters(t.point_cells, eps=25.0)
    return geocells.split_dense_cells(clustered, max_points=50).select("point_id", "cell_id", "cluster_id")


def clustered_points(t: Tables) -> DataFrame:
    """Named cells whose clusters follow the point ids, standing for an already clustered table."""
    return t.loc_points.select(
        "point_id",
        (F.col("country_id") % 5).alias("country"),
        F.concat(F.lit("a"), (F.col("country_id") % 2).cast("string")).alias("admin1"),
        F.col("country_id").alias("cell_id"),
        (F.col("point_id") % 3 - 1).alias("cluster_id"),
        "lat",
        "lon",
    )


_CLUSTERED = (
    "WITH k AS (SELECT point_id, country_id % 5 AS country, 'a' || country_id % 2 AS admin1, country_id AS cell_id, point_id % 3 - 1 AS cluster_id, lat, lon FROM @loc_points), "
    "ix AS (SELECT *, dense_rank() OVER (ORDER BY country, admin1, cell_id) - 1 AS geocell_index FROM k), "
    "m AS (SELECT cell_id, avg(lat) AS lat, avg(lon) AS lon FROM k GROUP BY 1) "
)


@query(
    _CLUSTERED
    + f"SELECT geocell_index, country, admin1, cell_id, cluster_id, count(*) AS count, {r4('coalesce(any_value(c.clat), any_value(m.lat))')} AS centroid_lat, "
    f"{r4('coalesce(any_value(c.clon), any_value(m.lon))')} AS centroid_lng FROM ix JOIN m USING (cell_id) LEFT JOIN (SELECT * FROM @cells WHERE admin0 <> 1) c ON c.geocell_index_ = ix.cell_id GROUP BY 1,2,3,4,5".replace(
        "(SELECT * FROM @cells WHERE admin0 <> 1)", "(SELECT geocell_index AS geocell_index_, clat, clon FROM @cells WHERE admin0 <> 1)"
    )
)
def prototype_table(t: Tables) -> DataFrame:
    shapes = t.cells.where("admin0 <> 1").select(
        F.col("geocell_index").alias("cell_id"), F.col("clat").alias("lat"), F.col("clon").alias("lon")
    )
    out = geocells.prototype_table(clustered_points(t), shapes)
    return out.withColumns({c: n4(c) for c in ("centroid_lat", "centroid_lng")})


@query(
    _CLUSTERED
    + "SELECT geocell_index, cluster_id, chunk, array_to_string(list(point_id ORDER BY point_id), ',') AS indices FROM (SELECT *, "
    "(row_number() OVER (PARTITION BY geocell_index, cluster_id ORDER BY point_id) - 1) // 16 AS chunk FROM ix) x GROUP BY 1, 2, 3"
)
def prototype_members(t: Tables) -> DataFrame:
    out = geocells.prototype_members(clustered_points(t), 16)
    return out.withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ","))


# ---- the whole build ----------------------------------------------------------

_BUILD_MERGE, _BUILD_EPS, _BUILD_TIGHT, _BUILD_MAX = 15, 9.0, 4.0, 30

_MERGING = (
    "SELECT * FROM (WITH cur AS (SELECT turn, cell_id, root FROM merging), "
    "region AS (SELECT root AS region, sum(n) AS n FROM cur JOIN base USING (cell_id) GROUP BY 1), "
    "edge AS (SELECT DISTINCT a.root AS src, b.root AS dst FROM nb JOIN cur a ON a.cell_id = nb.src JOIN cur b ON b.cell_id = nb.dst WHERE a.root <> b.root), "
    "wish AS (SELECT src AS region, min(dst) AS target, md5('42:' || (SELECT max(turn) FROM cur) || ':' || src) AS priority "
    f"FROM edge JOIN region ON region = src WHERE n < {_BUILD_MERGE} GROUP BY src), "
    "claim AS (SELECT region AS claimed, priority FROM wish UNION ALL SELECT target, priority FROM wish), "
    "held AS (SELECT claimed, min(priority) AS best FROM claim GROUP BY 1), "
    "moves AS (SELECT w.target AS old, w.region AS new FROM wish w JOIN held o ON o.claimed = w.region JOIN held t ON t.claimed = w.target WHERE o.best = priority AND t.best = priority) "
    "SELECT turn + 1 AS turn, cell_id, coalesce(new, root) AS root FROM cur LEFT JOIN moves ON root = old WHERE (SELECT count(*) FROM moves) > 0) z"
)


@query(
    "WITH RECURSIVE hits AS (SELECT point_id, lat, lon, cell_id FROM (SELECT point_id, lon, lat FROM @loc_points) p JOIN @admin2 ON lon > min_x AND lon < max_x AND lat > min_y AND lat < max_y WHERE admin1_id <> 7), "
    "base AS (SELECT a.cell_id, count(h.cell_id) AS n FROM @admin2 a LEFT JOIN hits h ON h.cell_id = a.cell_id GROUP BY 1), "
    "nb AS (SELECT a.cell_id AS src, b.cell_id AS dst FROM @admin2 a JOIN @admin2 b ON a.country_id = b.country_id AND a.cell_id <> b.cell_id "
    "AND a.max_x >= b.min_x AND b.max_x >= a.min_x AND a.max_y >= b.min_y AND b.max_y >= a.min_y), "
    f"merging(turn, cell_id, root) AS (SELECT 0, cell_id, cell_id FROM @admin2 UNION ALL {_MERGING}), "
    "joined AS (SELECT cell_id, root FROM merging WHERE turn = (SELECT max(turn) FROM merging)), "
    "box AS (SELECT *, (max_x - min_x) * (max_y - min_y) AS area FROM @admin2), "
    "shape AS (SELECT root, sum(area * (min_y + max_y) / 2) / sum(area) AS g_lat, sum(area * (min_x + max_x) / 2) / sum(area) AS g_lon FROM joined JOIN box USING (cell_id) GROUP BY 1), "
    "pts AS (SELECT point_id, lat, lon, CAST(root AS VARCHAR) AS cell_id FROM hits JOIN joined USING (cell_id)), "
    + _cluster_steps(f"SELECT DISTINCT cell_id, {_BUILD_EPS}::DOUBLE AS eps FROM pts", "pts", "1")
    + f", marked AS (SELECT *, count(*) OVER (PARTITION BY cell_id) > {_BUILD_MAX} AND count(*) OVER (PARTITION BY cell_id, cluster_id) > 10 AS split FROM clusters1), "
    "again AS (SELECT m.cell_id || '_' || m.cluster_id AS cell_id, point_id, lat, lon FROM marked m JOIN pts USING (point_id) WHERE split), "
    + _cluster_steps(f"SELECT DISTINCT cell_id, {_BUILD_TIGHT}::DOUBLE AS eps FROM again", "again", "2")
    + ", every AS (SELECT cell_id AS parent_id, cell_id, cluster_id, point_id FROM marked WHERE NOT split UNION ALL "
    "SELECT m.cell_id, c.cell_id, c.cluster_id, point_id FROM clusters2 c JOIN marked m USING (point_id)), "
    "named AS (SELECT e.*, a.country_id AS country, a.admin1_id AS admin1, p.lat, p.lon FROM every e JOIN @admin2 a ON a.cell_id = CAST(parent_id AS BIGINT) JOIN pts p USING (point_id)), "
    "mean AS (SELECT cell_id, avg(lat) AS m_lat, avg(lon) AS m_lon FROM named GROUP BY 1), "
    "ix AS (SELECT *, dense_rank() OVER (ORDER BY country, admin1, cell_id) - 1 AS geocell_index FROM named) "
    "SELECT geocell_index, CAST(country AS VARCHAR) AS country, CAST(admin1 AS VARCHAR) AS admin1, ix.cell_id, parent_id, cluster_id, count(*) AS count, "
    "string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY point_id) AS indices, "
    f"{r4('round(coalesce(any_value(g_lat), any_value(m_lat)), 8)')} AS centroid_lat, {r4('round(coalesce(any_value(g_lon), any_value(m_lon)), 8)')} AS centroid_lng "
    "FROM ix JOIN mean USING (cell_id) LEFT JOIN shape ON CAST(root AS VARCHAR) = ix.cell_id GROUP BY 1, 2, 3, 4, 5, 6"
)
def build_geocells(t: Tables) -> DataFrame:
    """All steps on real clusters, exported as prototype rows and read back."""
    ringed = box_rings(t.admin2).withColumn("rings", F.array("ring")).drop("ring", "min_x", "min_y", "max_x", "max_y")
    adm0, adm1, _ = admin_tables(t)
    adm2 = spatial.polygon_table(build.with_shape(ringed))
    rows = build.build_geocells(
        t.loc_points.drop("country_id"), adm0, adm1, adm2, _BUILD_EPS, _BUILD_TIGHT, min_cell=_BUILD_MERGE, max_points=_BUILD_MAX
    )
    path = work_path(t.spark, "prototypes")
    write_prototypes(rows, path, "csv")
    back = read_prototypes(t.spark, path, PROTOTYPE_SCHEMA.replace("cluster_id", "parent_id string, cluster_id", 1))
    back = back.withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ","))
    return back.withColumns({c: n4(F.round(c, 8)) for c in ("centroid_lat", "centroid_lng")})


# ---- sampling ----------------------------------------------------------------


def _u(axis: str) -> str:
    return f"(('0x' || substr(md5('42:{axis}:' || part_id || ':' || trial), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_PARTS = (
    "SELECT s_suppkey AS part_id, s_nationkey AS country, (s_suppkey % 50) * 3.0@D - 80.0@D AS px, (s_suppkey % 31) * 2.0@D - 40.0@D AS py, "
    "1.0@D + s_suppkey % 4 AS r FROM @supplier"
)


@query(
    "WITH parts AS (" + _PARTS + "), total AS (SELECT country, sum(2*r*r) AS a FROM parts GROUP BY 1), "
    "need AS (SELECT c_nationkey AS country, count(*) AS need FROM customer GROUP BY 1), "
    "want AS (SELECT part_id, country, px, py, r, least(cum, need) - least(cum - k, need) AS take FROM (SELECT *, CAST(sum(k) OVER (PARTITION BY country ORDER BY part_id) AS BIGINT) AS cum "
    "FROM (SELECT *, CAST(round_even(2*r*r / a * need, 0) AS BIGINT) AS k FROM parts JOIN total USING (country) JOIN need USING (country)) z) y), "
    "draw AS (SELECT *, unnest(generate_series(1, 100 + take * 8)) AS trial FROM want WHERE take > 0), "
    f"spot AS (SELECT *, px - r + {_u('x')} * (2*r) AS lon, py - r + {_u('y')} * (2*r) AS lat FROM draw), "
    "hit AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY trial) AS n FROM spot WHERE abs(lon - px) + abs(lat - py) < r) "
    f"SELECT country, part_id, CAST(trial AS BIGINT) AS trial, {r4('lat')} AS lat, {r4('lon')} AS lon FROM hit WHERE n <= take"
)
def sample_in_polygons(t: Tables) -> DataFrame:
    """Diamond-shaped parts per supplier, as many points per country as it has customers."""
    need = t.customer.groupBy(F.col("c_nationkey").alias("country")).agg(F.count(F.lit(1)).alias("need"))
    x, y, r = F.col("px"), F.col("py"), F.col("r")
    corners = [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])
    parts = t.sql(_PARTS).select("part_id", "country", (2 * r * r).alias("area"), F.array(ring).alias("rings"))
    out = sampling.sample_in_polygons(spatial.polygon_table(parts).join(need, "country"), "need")
    return out.select("country", "part_id", "trial", n4("lat").alias("lat"), n4("lon").alias("lon"))


RUN_TARGET, RUN_LIMIT, RUN_ROUNDS, RUN_RADIUS_M = 30, 200, 4, 200_000.0


def _run_round(k: int) -> str:
    """One round: what open countries ask for, its draws, the positions that are new, and the sums after it."""
    u = {a: f"(('0x' || substr(md5('{42 + k}:{a}:' || part_id || ':' || trial), 1, 8))::BIGINT / 4294967296.0::DOUBLE)" for a in "xy"}
    km = haversine("h.lat", "h.lon", "s.lat", "s.lon", K.SCORE_RADIUS_M)
    old = " AND ".join(
        ["TRUE", *[f"NOT EXISTS (SELECT 1 FROM fresh{j} o WHERE o.country = f.country AND o.lat = f.lat AND o.lon = f.lon)" for j in range(k)]]
    )
    more = (
        f"CASE WHEN asked = 0 THEN {RUN_TARGET} WHEN covered = 0 THEN asked ELSE "
        f"greatest(CAST(ceil(({RUN_TARGET} - covered) * candidates / CAST(nullif(covered, 0) AS DOUBLE)) AS BIGINT), CAST(ceil(asked / 2.0) AS BIGINT)) END"
    )
    return (
        f"more{k} AS MATERIALIZED (SELECT country, least({more}, {RUN_LIMIT} - asked) AS more FROM state{k} WHERE covered < {RUN_TARGET} AND asked < {RUN_LIMIT}), "
        f"want{k} AS MATERIALIZED (SELECT part_id, country, px, py, r, least(cum, more) - least(cum - n, more) AS take FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY country ORDER BY part_id) AS BIGINT) AS cum "
        f"FROM (SELECT *, CAST(round_even(2*r*r * 1.25::DOUBLE / a * more, 0) AS BIGINT) AS n FROM parts JOIN total USING (country) JOIN more{k} USING (country)) z) y), "
        f"draw{k} AS (SELECT *, unnest(generate_series(1, 100 + take * 8)) AS trial FROM want{k} WHERE take > 0), "
        f"spot{k} AS (SELECT *, px - r + {u['x']} * (2*r) AS lon, py - r + {u['y']} * (2*r) AS lat FROM draw{k}), "
        f"hit{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY trial) AS pos FROM spot{k} WHERE abs(lon - px) + abs(lat - py) < r) x WHERE pos <= take), "
        f"near{k} AS (SELECT * FROM (SELECT h.country, s.lat, s.lon, row_number() OVER (PARTITION BY h.part_id, h.trial ORDER BY {km}, s.lat, s.lon) AS pos "
        f"FROM hit{k} h JOIN site s ON abs(h.lat - s.lat) < 2 AND {km} <= {RUN_RADIUS_M / 1000!r}) x WHERE pos = 1), "
        f"fresh{k} AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT country, round_even(lat*1e6::DOUBLE,0)/1e6::DOUBLE AS lat, round_even(lon*1e6::DOUBLE,0)/1e6::DOUBLE AS lon FROM near{k}) f WHERE {old}), "
        f"state{k + 1} AS MATERIALIZED (SELECT country, CAST(asked + coalesce(more, 0) AS BIGINT) AS asked, candidates + coalesce(c, 0) AS candidates, covered + coalesce(f, 0) AS covered, "
        f"rounds + CAST(more IS NOT NULL AS BIGINT) AS rounds FROM state{k} LEFT JOIN more{k} USING (country) "
        f"LEFT JOIN (SELECT country, count(*) AS c FROM hit{k} GROUP BY 1) USING (country) LEFT JOIN (SELECT country, count(*) AS f FROM fresh{k} GROUP BY 1) USING (country)), "
    )


@query(
    "WITH parts AS MATERIALIZED (SELECT * REPLACE (n_name AS country, row_number() OVER (ORDER BY n_name, part_id) - 1 AS part_id) FROM (" + _PARTS + ") p JOIN @nation ON n_nationkey = country WHERE n_regionkey <> 2), "
    "total AS (SELECT country, sum(2*r*r) AS a FROM parts GROUP BY 1), site AS MATERIALIZED (SELECT DISTINCT lat, lon FROM @loc_points), "
    "state0 AS (SELECT country, 0::BIGINT AS asked, 0::BIGINT AS candidates, 0::BIGINT AS covered, 0::BIGINT AS rounds FROM total), "
    + "".join(_run_round(k) for k in range(RUN_ROUNDS))
    + "fresh AS (" + " UNION ALL ".join(f"SELECT *, {k} AS round FROM fresh{k}" for k in range(RUN_ROUNDS)) + ") "
    f"SELECT country, lat, lon, round, asked, candidates, covered, rounds, {r4('rate')} AS rate, CAST(ceil({RUN_TARGET}00.0::DOUBLE / nullif(rate, 0)) AS BIGINT) AS needed "
    f"FROM (SELECT *, coalesce(covered * 100.0::DOUBLE / nullif(candidates, 0), 0.0::DOUBLE) AS rate FROM state{RUN_ROUNDS}) s LEFT JOIN fresh USING (country)"
)
def sampling_run(t: Tables) -> DataFrame:
    """Boundary files to covered points: files read, countries picked, candidates drawn in rounds until enough are covered.

    One file per nation with a diamond per supplier; customers' places are covered.  A country without any covered
    position has one row without coordinates.
    """
    folder = work_path(t.spark, "countries")
    x, y, r = F.col("px"), F.col("py"), F.col("r")
    corners = [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(a, b) for a, b in corners])).alias("coordinates"))
    names = F.struct(F.col("n_name").alias("NAME_0"), F.format_string("%012d", "part_id").alias("NAME_1"))
    feature = F.struct(F.lit("Feature").alias("type"), names.alias("properties"), shape.alias("geometry"))
    features = t.sql(_PARTS).join(t.nation, F.col("country") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.collect_list(feature).alias("features"))
    collection = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))
    features.select("n_nationkey", collection.alias("value")).write.partitionBy("n_nationkey").text(folder)
    wanted = t.nation.where("n_regionkey <> 2").select(F.concat(F.lit(" "), F.lower("n_name")).alias("name"))
    land = tables.filter_countries(read_boundaries(t.spark, f"{folder}/*", ("NAME_0",), "*.txt"), wanted, ("country",))
    run = sampling.sampling_run(
        sampling.boundary_parts(land), t.loc_points, RUN_TARGET, RUN_RADIUS_M, 1.25, limit=RUN_LIMIT, max_rounds=RUN_ROUNDS
    )
    out = run.report.join(run.points, "country", "left").withColumn("rate", n4("rate"))
    return out.select("country", "lat", "lon", "round", "asked", "candidates", "covered", "rounds", "rate", "needed")
