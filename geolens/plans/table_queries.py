"""Queries over snapshots, splits, picks, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.operators import measures, tables
from geolens.operators.enrich import enrich_snapshot as enrich
from geolens.operators.spread import global_index
from geolens.plans.views import Tables, oracle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return add


# ---- snapshots ---------------------------------------------------------------


@query(
    "SELECT location_id, wanted_heading, heading, ord FROM (SELECT *, row_number() OVER (PARTITION BY location_id, wanted_heading "
    "ORDER BY abs((((heading - wanted_heading + 180) % 360) + 360) % 360 - 180), ord) AS n FROM (SELECT location_id, ord, "
    "CAST((ord*37) % 360 AS INTEGER) AS heading, CAST(q*90 AS INTEGER) AS wanted_heading FROM @image_rows, @quarters) x) y WHERE n = 1"
)
def nearest_heading(t: Tables) -> DataFrame:
    turned = t.image_rows.withColumn("heading", ((F.col("ord") * 37) % 360).cast("int"))
    return tables.nearest_heading(turned).select("location_id", "wanted_heading", "heading", "ord")


@query(
    "SELECT location_id, heading, ord, value, CASE WHEN is_new = 1 THEN batch_date END AS batch_date FROM (SELECT *, row_number() OVER "
    "(PARTITION BY location_id, heading ORDER BY is_new DESC, ord DESC) AS n FROM @image_rows) x WHERE n = 1"
)
def merge_latest_wins(t: Tables) -> DataFrame:
    """Old rows lack the column batch_date, which the union fills with NULL."""
    rows = t.image_rows
    old = rows.where("is_new = 0").drop("is_new", "batch_date")
    return tables.merge_latest_wins(old, rows.where("is_new = 1").drop("is_new"))


@query(
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) x WHERE n = 1"
)
def dedupe_keep_first(t: Tables) -> DataFrame:
    first = tables.dedupe_keep_first(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey")


@query(
    "SELECT location_id, array_to_string(list(heading ORDER BY heading), ',') AS headings, array_to_string(list(ord ORDER BY heading), ',') AS images, "
    "min_by(ord, heading) AS first_image FROM (SELECT *, row_number() OVER (PARTITION BY location_id, heading ORDER BY ord DESC) AS n FROM @image_rows) x "
    "WHERE n = 1 GROUP BY 1"
)
def build_panoramas(t: Tables) -> DataFrame:
    rows = t.image_rows.withColumns({"image": F.col("ord"), "lat": F.col("ord"), "lon": F.col("ord")})
    out = tables.build_panoramas(rows)
    return out.select(
        "location_id",
        F.array_join(F.col("headings").cast("array<string>"), ",").alias("headings"),
        F.array_join(F.col("images").cast("array<string>"), ",").alias("images"),
        F.col("lat").alias("first_image"),
    )


@query(
    "SELECT (SELECT count(*) FROM @image_rows WHERE is_new = 1) AS rows_in_batch, count(*) AS rows_in_latest, "
    "count(DISTINCT location_id) AS distinct_locations FROM (SELECT DISTINCT location_id, heading FROM @image_rows) x"
)
def ingest_report(t: Tables) -> DataFrame:
    rows = t.image_rows
    batch = rows.where("is_new = 1")
    latest = tables.merge_latest_wins(rows.where("is_new = 0"), batch)
    return tables.ingest_report(batch, latest)


# ---- splits and indexes ------------------------------------------------------


@query(
    "SELECT o_orderkey, CASE WHEN at < CAST(floor(0.9::DOUBLE * n) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM "
    "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS \"at\", count(*) OVER () AS n FROM orders) x".replace(
        " at <", ' "at" <'
    )
)
def split_ordered(t: Tables) -> DataFrame:
    train, test = tables.split_ordered(t.orders, [F.col("o_orderdate"), F.col("o_orderkey")])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("o_orderkey", "part")


@query(
    "SELECT c_custkey, c_mktsegment, CASE WHEN r <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER "
    "(PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) x"
)
def split_stratified(t: Tables) -> DataFrame:
    train, val = tables.split_stratified(t.customer, "c_mktsegment", "c_custkey")
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return both.select("c_custkey", "c_mktsegment", "part")


PARTS_SQL = (
    "SELECT c_custkey AS part_id, c_nationkey AS country, CAST(1 + c_custkey % 17 AS DOUBLE) AS area, 40 + c_nationkey AS need FROM customer"
)


def area_parts(t: Tables) -> DataFrame:
    return t.sql(PARTS_SQL.replace("customer", "@customer"))


ALLOCATE_SQL = (
    "SELECT part_id, country, least(cum, need) - least(cum - r, need) AS take FROM (SELECT *, CAST(sum(r) OVER (PARTITION BY country ORDER BY part_id) AS BIGINT) AS cum "
    "FROM (SELECT *, CAST(round_even(area * 1.5::DOUBLE / sum(area) OVER (PARTITION BY country) * need, 0) AS BIGINT) AS r FROM (" + PARTS_SQL + ") p) q) s"
)


@query(ALLOCATE_SQL)
def allocate_by_area(t: Tables) -> DataFrame:
    return tables.allocate_by_area(area_parts(t), "need", 1.5).select("part_id", "country", "take")


@query(
    "SELECT country, admin1, cell_id, dense_rank() OVER (ORDER BY country, admin1, cell_id) - 1 AS geocell_index FROM "
    "(SELECT DISTINCT l_returnflag AS country, l_linestatus AS admin1, l_suppkey AS cell_id FROM lineitem) x"
)
def geocell_index(t: Tables) -> DataFrame:
    cells = t.lineitem.select(
        F.col("l_returnflag").alias("country"), F.col("l_linestatus").alias("admin1"), F.col("l_suppkey").alias("cell_id")
    )
    return tables.geocell_index(cells)


@query(
    "WITH m AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS label_id FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 40) x) "
    "SELECT p_partkey, coalesce(label_id, (SELECT count(*) FROM m)) AS label_id, coalesce(name, 'UNKNOWN') AS class_name FROM "
    "(SELECT p_partkey, CASE WHEN p_size = 50 THEN 'other' ELSE p_brand END AS b FROM part) p LEFT JOIN m ON m.name = p.b"
)
def label_map(t: Tables) -> DataFrame:
    labels = tables.label_map(t.part.where("p_size < 40"), "p_brand")
    brand = F.when(F.col("p_size") == 50, F.lit("other")).otherwise(F.col("p_brand"))
    named = tables.apply_label_map(t.part.select("p_partkey", brand.alias("b")), "b", labels)
    return named.select("p_partkey", "label_id", "class_name")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 25 AS batch FROM orders")
def batch_number(t: Tables) -> DataFrame:
    return tables.batch_number(t.orders, [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "batch")


@query(
    "SELECT v AS version FROM (SELECT DISTINCT regexp_extract(k, 'run_ts=([^/]+)', 1) AS v FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'models/readme' ELSE "
    "'models/run_ts=' || substr(CAST(ts AS VARCHAR), 1, 13) || '/w.ckpt' END AS k FROM events) e) x WHERE v <> '' ORDER BY v DESC LIMIT 1 OFFSET 3"
)
def version_nth(t: Tables) -> DataFrame:
    stamp = F.substring(F.col("ts").cast("string"), 1, 13)
    key = F.concat(F.lit("models/run_ts="), stamp, F.lit("/w.ckpt"))
    keys = t.events.select(F.when(F.col("event_id") % 10 == 0, F.lit("models/readme")).otherwise(key).alias("key"))
    return tables.version_nth(keys, 3)


# ---- ordered picks -----------------------------------------------------------


@query("SELECT point_id, lat, lon FROM @loc_points ORDER BY lat, lon LIMIT 2425")
def collection_budget(t: Tables) -> DataFrame:
    return tables.collection_budget(t.loc_points, 9700 // 4).select("point_id", "lat", "lon")


@query(
    "SELECT cell_id, n_points, row_number() OVER (ORDER BY n_points DESC, cell_id) AS rank FROM "
    "(SELECT cell_id, count(*) AS n_points FROM @point_cells GROUP BY 1) x"
)
def rank_cells(t: Tables) -> DataFrame:
    stats = measures.cell_stats(t.point_cells, ["cell_id"])
    ordered = tables.rank_cells(stats).select("cell_id", "n_points")
    ranked = global_index(ordered, [F.col("n_points").desc(), F.col("cell_id")], "at")
    return ranked.select("cell_id", "n_points", (F.col("at") + 1).alias("rank"))


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 1000")
def sample_n(t: Tables) -> DataFrame:
    return tables.sample_n(t.orders, "o_orderkey", 1000).select("o_orderkey")


@query(
    "WITH c AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY heading, ord) AS tile, count(*) OVER (PARTITION BY location_id) AS n FROM @image_rows), "
    "one AS (SELECT location_id FROM c WHERE n >= 4 GROUP BY 1 ORDER BY md5('42:' || location_id), location_id LIMIT 1) "
    "SELECT location_id, heading, ord FROM c JOIN one USING (location_id) WHERE tile <= 4"
)
def random_panorama(t: Tables) -> DataFrame:
    return tables.random_panorama(t.image_rows).select("location_id", "heading", "ord")


# ---- sets --------------------------------------------------------------------

SHIFTED_SQL = (
    "SELECT point_id AS ord, CASE WHEN point_id % 2 = 0 THEN lat + 0.0000001@D ELSE lat + 0.5@D END AS lat, lon FROM @loc_points"
)
_R6 = "round_even({0} * 1e6::DOUBLE, 0) / 1e6::DOUBLE"
UNION_SQL = (
    "SELECT ord, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY "
    + _R6.format("lat")
    + ", "
    + _R6.format("lon")
    + " ORDER BY src, ord) AS n FROM (SELECT 0 AS src, point_id AS ord, lat, lon FROM @loc_points UNION ALL SELECT 1, ord, lat, lon FROM ("
    + SHIFTED_SQL
    + ") s) u) v WHERE n = 1"
)


def point_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.loc_points.select(F.col("point_id").alias("ord"), "lat", "lon"), t.sql(SHIFTED_SQL)


@query(UNION_SQL)
def union_dedupe(t: Tables) -> DataFrame:
    return tables.union_dedupe(*point_lists(t)).select("ord", "lat", "lon")


@query("SELECT lat, lon FROM @coverage EXCEPT SELECT lat + 0.01@D, lon FROM @loc_points")
def point_difference(t: Tables) -> DataFrame:
    moved = t.loc_points.withColumn("lat", F.col("lat") + 0.01)
    return tables.point_difference(t.coverage, moved)


@query("SELECT DISTINCT CAST(floor(lat / 2) AS DOUBLE) AS lat, CAST(floor(lon / 2) AS DOUBLE) AS lon FROM @loc_points")
def distinct_points(t: Tables) -> DataFrame:
    halves = [F.floor(F.col(c) / 2).cast("double").alias(c) for c in ("lat", "lon")]
    return tables.distinct_points(t.loc_points.select(*halves))


@query(
    "WITH u AS (" + UNION_SQL + "), done AS (SELECT lat, lon FROM @loc_points WHERE country_id < 8 UNION ALL SELECT lat + 0.5@D, lon FROM @loc_points WHERE country_id >= 20), "
    "open AS (SELECT lat, lon FROM u EXCEPT SELECT lat, lon FROM done), pick AS (SELECT lat, lon FROM open ORDER BY lat, lon LIMIT 2425) "
    "SELECT lat, lon, (row_number() OVER (ORDER BY lat, lon) - 1) // 25 AS batch FROM pick"
)
def collection_plan(t: Tables) -> DataFrame:
    collected = t.loc_points.where("country_id < 8")
    failed = t.loc_points.where("country_id >= 20").withColumn("lat", F.col("lat") + 0.5)
    return tables.collection_plan(*point_lists(t), collected, failed, 9700 // 4)


# ---- lookups -----------------------------------------------------------------

_INFO = (
    "SELECT point_id AS ord, lat, lon, concat('c', CAST(country_id AS STRING)) AS country, 'a' AS admin1, "
    "concat('g', CAST(point_id % 9 AS STRING)) AS geocell, CASE WHEN point_id % 3 = 0 THEN NULL ELSE point_id % 4 END AS cluster_id "
    "FROM @loc_points WHERE country_id <> 3 UNION ALL SELECT point_id + 1000000, lat, lon, 'later', 'b', 'h', 5 FROM @loc_points WHERE country_id = 5"
)


@query(
    "WITH i AS (" + _INFO + "), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY ord DESC) AS n FROM i) x WHERE n = 1) "
    "SELECT point_id, l.country, l.admin1, l.geocell, CASE WHEN l.geocell IS NULL THEN NULL ELSE coalesce(l.cluster_id, -1) END AS cluster_id "
    "FROM @loc_points p LEFT JOIN l ON p.lat = l.lat AND p.lon = l.lon"
)
def point_cell_info(t: Tables) -> DataFrame:
    out = tables.point_cell_info(t.loc_points, t.sql(_INFO))
    return out.select("point_id", "country", "admin1", "geocell", "cluster_id")


def _legend() -> str:
    return " ".join(f"WHEN {code} THEN '{text}'" for code, text in K.CLIMATE_LEGEND.items())


RASTER_JOIN = "LEFT JOIN @raster r ON r.row = floor((90.0@D - lat)/5.0@D) AND r.col = floor((lon + 180.0@D)/5.0@D)"


@query(f"SELECT point_id, CASE r.value {_legend()} END AS climate FROM @loc_points p {RASTER_JOIN}")
def raster_sample(t: Tables) -> DataFrame:
    out = tables.raster_sample(t.loc_points, t.raster, (-180.0, 90.0), (5.0, 5.0), K.CLIMATE_LEGEND)
    return out.select("point_id", "climate")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(country, '?') AS country, coalesce(admin1, '?') AS admin1 FROM (SELECT *, l_suppkey % 40 AS g FROM lineitem) l LEFT JOIN "
    "(SELECT g, min_by(s_name, s_suppkey) AS country, 'n' || min_by(s_nationkey, s_suppkey) AS admin1 FROM (SELECT *, s_suppkey % 30 AS g FROM supplier) s GROUP BY 1) m USING (g)"
)
def geocell_meta(t: Tables) -> DataFrame:
    protos = t.supplier.select(
        (F.col("s_suppkey") % 30).alias("geocell_index"),
        F.col("s_name").alias("country"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("admin1"),
        F.col("s_suppkey").alias("ord"),
    )
    lines = t.lineitem.withColumn("geocell_index", F.col("l_suppkey") % 40)
    return tables.geocell_meta(lines, protos).select("l_orderkey", "l_linenumber", "l_partkey", "country", "admin1")


@query(
    "SELECT m.geocell_index, m.cluster_id, m.point_idx, lat, lon FROM @members m"
)
def attach_by_index(t: Tables) -> DataFrame:
    """Lists built per prototype lead back to exactly the members they were built from."""
    lists = t.members.groupBy("geocell_index", "cluster_id", F.expr("point_idx div 64").alias("chunk"))
    protos = lists.agg(F.collect_list("point_idx").alias("indices"))
    out = tables.attach_by_index(protos, t.members.select("point_idx", "lat", "lon"))
    return out.select("geocell_index", "cluster_id", "point_idx", "lat", "lon")


@query(
    "SELECT point_id AS row_id, lat, CAST(point_id AS BIGINT) AS e FROM @loc_points"
)
def restore_order_join(t: Tables) -> DataFrame:
    """Two gathered copies of every row plus padding beyond the last row."""
    rows = t.loc_points.select(F.col("point_id").alias("row_id"), "lat")
    n = rows.count()
    gathered = rows.select("row_id", F.col("row_id").alias("e"), F.lit(0).alias("ord"))
    again = rows.select("row_id", (-F.col("row_id")).alias("e"), F.lit(1).alias("ord"))
    padding = rows.select((F.col("row_id") + n).alias("row_id"), F.lit(0).cast("bigint").alias("e"), F.lit(0).alias("ord"))
    return tables.restore_order_join(rows, gathered.unionByName(again).unionByName(padding), n)


@query(
    "SELECT c_nationkey AS country, count(*) AS n, rate FROM customer LEFT JOIN (SELECT n_nationkey, (n_nationkey % 9 + 1)/10.0::DOUBLE AS rate FROM nation "
    "WHERE n_regionkey <> 2) r ON r.n_nationkey = c_nationkey GROUP BY 1, 3"
)
def country_rate_join(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("country")).agg(F.count(F.lit(1)).alias("n"))
    rates = t.nation.where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("country"), ((F.col("n_nationkey") % 9 + 1) / 10.0).alias("rate")
    )
    return tables.country_rate_join(counts, rates)


@query(
    "WITH i AS (" + _INFO + "), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY ord DESC) AS n FROM i) x WHERE n = 1) "
    f"SELECT point_id, CASE strftime(DATE '2023-01-15' + INTERVAL (point_id % 12) MONTH, '%m') {' '.join(f'''WHEN '{c}' THEN '{n}' ''' for c, n in K.MONTHS.items())} END AS month, "
    f"l.country, l.admin1 AS region, l.geocell AS cell, CASE r.value {_legend()} END AS climate, coalesce(l.country <> 'c7', false) AS drive_right "
    "FROM @loc_points p LEFT JOIN l ON p.lat = l.lat AND p.lon = l.lon "
    "LEFT JOIN @raster r ON r.row = floor((90.0@D - p.lat)/5.0@D) AND r.col = floor((p.lon + 180.0@D)/5.0@D)"
)
def enrich_snapshot(t: Tables) -> DataFrame:
    month = F.lpad((F.col("point_id") % 12 + 1).cast("string"), 2, "0")
    snapshot = t.loc_points.select(
        "point_id", "lat", "lon", F.concat(F.lit("2023-"), month, F.lit("-15")).alias("batch_date")
    )
    out = enrich(snapshot, t.sql(_INFO), t.raster, (-180.0, 90.0), (5.0, 5.0), K.CLIMATE_LEGEND, ["c7"])
    return out.select("point_id", "month", "country", "region", "cell", "climate", "drive_right")
