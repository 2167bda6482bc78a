"""Queries over scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions import geometry as G
from geolens.functions import scalar as S
from geolens.functions.sql import register_functions
from geolens.operators import measures, tables
from geolens.plans.views import Tables, haversine, oracle, r4
from geolens.session import range_tasks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return add


def n4(column) -> Column:
    """Half-even rounding to four decimals."""
    column = F.col(column) if isinstance(column, str) else column
    return F.rint(column * F.lit(10000.0)) / F.lit(10000.0)


def quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def _months(code: str) -> str:
    arms = " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in K.MONTHS.items())
    return f"CASE {code} {arms} ELSE {code} END"


def _display(country: str) -> str:
    return (
        f"CASE WHEN {country} = 'United States Of America' THEN 'the United States' "
        f"WHEN {country} IN ({quoted(K.ARTICLE_COUNTRIES)}) THEN 'the ' || {country} ELSE {country} END"
    )


# ---- identifiers -------------------------------------------------------------

_INT32 = "printf('%08x', round_even({0} * 1e7::DOUBLE, 0)::BIGINT & 4294967295)"


@query(
    "SELECT point_id, left(sha1(unhex(hex('geo:v1:') || "
    + _INT32.format("lat")
    + " || "
    + _INT32.format("lon")
    + ")), 12) AS location_id FROM @loc_points"
)
def location_id(t: Tables) -> DataFrame:
    return t.loc_points.select("point_id", S.location_id(F.col("lat"), F.col("lon")).alias("location_id"))


@query(
    "SELECT ord, k AS key, 's3://bucket/' || k AS uri, '/local/' || substr(k, 11) AS local FROM (SELECT ord, "
    "'v1/images/location_id=' || location_id || '/heading=' || printf('%03d', heading) || '.jpg' AS k FROM @image_rows) x"
)
def image_key(t: Tables) -> DataFrame:
    key = S.image_key(F.col("location_id").cast("string"), F.col("heading"))
    uri = S.image_uri(F.col("key"), "bucket")
    return t.image_rows.select("ord", key.alias("key")).select(
        "ord", "key", uri.alias("uri"), S.local_path(uri, "/local").alias("local")
    )


# ---- distances ---------------------------------------------------------------


@query(
    f"SELECT point_id, {r4(haversine('lat', 'lon', 'pred_lat', 'pred_lon', K.SCORE_RADIUS_M))} AS score_km, "
    f"{r4(haversine('lat', 'lon', 'pred_lat', 'pred_lon', K.LABEL_RADIUS_M))} AS label_km FROM @guesses"
)
def haversine_km(t: Tables) -> DataFrame:
    ends = [F.col(c) for c in ("lat", "lon", "pred_lat", "pred_lon")]
    return t.guesses.select(
        "point_id",
        n4(S.haversine_km(*ends)).alias("score_km"),
        n4(S.haversine_km(*ends, K.LABEL_RADIUS_M)).alias("label_km"),
    )


_NORMAL = (
    f"{K.LABEL_RADIUS_M}::DOUBLE / sqrt(pow(cos(radians(lat)), 2) + "
    f"{(1 - K.WGS84_FLATTENING) ** 2!r}::DOUBLE * pow(sin(radians(lat)), 2))"
)


@query(
    f"SELECT point_id, {r4('n * cos(radians(lat)) * cos(radians(lon))')} AS x, "
    f"{r4('n * cos(radians(lat)) * sin(radians(lon))')} AS y, "
    f"{r4(f'n * {(1 - K.WGS84_FLATTENING) ** 2!r}::DOUBLE * sin(radians(lat))')} AS z "
    f"FROM (SELECT *, {_NORMAL} AS n FROM @loc_points) p"
)
def ecef_from_lla(t: Tables) -> DataFrame:
    at = t.loc_points.select("point_id", S.ecef_from_lla(F.col("lat"), F.col("lon")).alias("e"))
    return at.select("point_id", *[n4(f"e.{axis}").alias(axis) for axis in "xyz"])


@query(
    "SELECT point_id, lat AS closed_lat, lon AS closed_lon, lat AS iterated_lat, lon AS iterated_lon "
    "FROM (SELECT point_id, " + r4("lat") + " AS lat, " + r4("lon") + " AS lon FROM @loc_points) p"
)
def lla_from_ecef(t: Tables) -> DataFrame:
    """Back from earth-centred coordinates; the oracle is the position started from."""
    at = t.loc_points.select("point_id", S.ecef_from_lla(F.col("lat"), F.col("lon")).alias("e"))
    xyz = [F.col(f"e.{axis}") for axis in "xyz"]
    both = at.select(
        "point_id",
        S.lla_from_ecef(*xyz).alias("closed"),
        S.lla_from_ecef(*xyz, method="iterated").alias("iterated"),
    )
    return both.select(
        "point_id",
        *[n4(f"{m}.{c}").alias(f"{m}_{c}") for m in ("closed", "iterated") for c in ("lat", "lon")],
    )


_KM = haversine("lat", "lon", "pred_lat", "pred_lon", K.SCORE_RADIUS_M)
SCORE_SQL = "CAST(round_even(least(5000.0::DOUBLE, greatest(0.0::DOUBLE, 5000.0::DOUBLE*exp(-greatest({0},0.0::DOUBLE)/1492.7::DOUBLE))), 0) AS INTEGER)"


@query(f"SELECT point_id, {SCORE_SQL.format(_KM)} AS score FROM @guesses")
def game_score(t: Tables) -> DataFrame:
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("pred_lat"), F.col("pred_lon"))
    return t.guesses.select("point_id", S.game_score(km).alias("score"))


@query(
    "SELECT ord, CAST(abs((((heading - (ord*37)%360 + 180) % 360) + 360) % 360 - 180) AS BIGINT) AS turn FROM @image_rows"
)
def heading_distance(t: Tables) -> DataFrame:
    turn = S.heading_distance(F.col("heading").cast("bigint"), (F.col("ord") * 37) % 360)
    return t.image_rows.select("ord", turn.alias("turn"))


@query(
    f"SELECT event_id, i AS view, {r4('sin(radians(event_id % 360 + 90.0::DOUBLE*i))')} AS s, "
    f"{r4('cos(radians(event_id % 360 + 90.0::DOUBLE*i))')} AS c FROM @events, (SELECT q AS i FROM @quarters) v"
)
def heading_features(t: Tables) -> DataFrame:
    features = S.heading_features((F.col("event_id") % 360).cast("double"))
    rows = t.events.select("event_id", F.posexplode(features).alias("view", "v"))
    # Tiny negative sines round to -0.0; adding 0.0 makes them 0.0 as in SQL.
    return rows.select("event_id", "view", n4(F.col("v")[0]).alias("s"), n4(F.col("v")[1]).alias("c"))


# ---- labels ------------------------------------------------------------------


@query(
    f"SELECT ord, CASE WHEN ord % 3 <> 0 THEN {_months('substr(batch_date, 6, 2)')} "
    "WHEN ord % 2 = 0 THEN '13' ELSE NULL END AS month FROM @image_rows"
)
def month_features(t: Tables) -> DataFrame:
    batch = F.when(F.col("ord") % 3 != 0, F.col("batch_date"))
    capture = F.when(F.col("ord") % 2 == 0, F.lit("2020-13"))
    return t.image_rows.select("ord", S.month_features(batch, capture).alias("month"))


@query(
    f"SELECT point_id, coalesce(country NOT IN ({quoted(K.LEFT_DRIVING)}), false) AS drive_right FROM @named_points"
)
def drive_right(t: Tables) -> DataFrame:
    return t.named_points.select("point_id", S.drive_right(F.col("country")).alias("drive_right"))


@query(f"SELECT point_id, {_display('country')} AS display FROM @named_points")
def country_display(t: Tables) -> DataFrame:
    return t.named_points.select("point_id", S.country_display(F.col("country")).alias("display"))


def _u(salt: str) -> str:
    return f"(('0x' || substr(md5('42:{salt}:' || point_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _caption_sql(optional: bool) -> str:
    where = (
        "CASE WHEN country IS NOT NULL THEN 'A Street View photo ' || town_s || region_s || 'in ' || display || '.' "
        "ELSE 'A Street View photo taken around latitude ' || printf('%.3f', lat) || ', longitude ' || printf('%.3f', lon) || '.' END"
    )
    if optional:
        where = f"CASE WHEN climate_s <> '' AND NOT ({_u('location')} > {1 - 0.7!r}::DOUBLE) THEN '' ELSE {where} END"
    month = _months("substr(capture_date, 6, 2)")
    return f"""
    WITH a AS (SELECT *, {_display('country')} AS display,
      CASE WHEN region IS NOT NULL AND {_u('region')} > {1 - 0.6!r}::DOUBLE THEN 'in the region of ' || region || ' ' ELSE '' END AS region_s,
      CASE WHEN town IS NOT NULL AND {_u('town')} > {1 - 0.4!r}::DOUBLE THEN 'close to the town of ' || town || ' ' ELSE '' END AS town_s,
      CASE WHEN climate IS NOT NULL AND {_u('climate')} > {1 - 0.4!r}::DOUBLE THEN ' This location has ' || lower(climate) || '.' ELSE '' END AS climate_s,
      CASE WHEN month IS NOT NULL AND {_u('month')} > {1 - 0.3!r}::DOUBLE THEN ' The photo was taken in ' || month || '.'
           WHEN capture_date IS NOT NULL AND {_u('capture')} > {1 - 0.3!r}::DOUBLE THEN ' The photo was taken in ' || {month} || '.' ELSE '' END AS month_s
      FROM @named_points),
    b AS (SELECT *, CASE WHEN country IS NOT NULL AND climate_s = '' AND {_u('side')} > {1 - 0.3!r}::DOUBLE THEN
      ' In this location, people drive on the ' || CASE WHEN coalesce(country NOT IN ({quoted(K.LEFT_DRIVING)}), false) THEN 'right' ELSE 'left' END
      || ' side of the road.' ELSE '' END AS side_s FROM a)
    SELECT point_id, trim({where} || array_to_string(list_transform(list_sort([
      {{'k': {_u('order-climate')}, 't': climate_s}}, {{'k': {_u('order-side')}, 't': side_s}}, {{'k': {_u('order-month')}, 't': month_s}}]),
      lambda s: s.t), '')) AS caption FROM b"""


@query(_caption_sql(False))
def caption(t: Tables) -> DataFrame:
    sided = t.named_points.withColumn("drive_right", S.drive_right(F.col("country")))
    return S.caption(sided, key="point_id").select("point_id", "caption")


@query(_caption_sql(True))
def caption_location_optional(t: Tables) -> DataFrame:
    sided = t.named_points.withColumn("drive_right", S.drive_right(F.col("country")))
    return S.caption(sided, key="point_id", location_optional=True).select("point_id", "caption")


@query(
    "SELECT doc_id, text IS NOT NULL AND regexp_matches(text, '\\S') AS has_text, false AS has_blank, "
    "n_chars > 100 AS has_number FROM documents"
)
def is_valid(t: Tables) -> DataFrame:
    number = F.when(F.col("n_chars") > 100, F.col("n_chars").cast("double")).otherwise(F.lit(float("nan")))
    return t.documents.select(
        "doc_id",
        S.is_valid(F.col("text")).alias("has_text"),
        S.is_valid(F.concat(F.lit(" \t"), F.regexp_replace("lang", ".", " "))).alias("has_blank"),
        S.is_valid(number, floating=True).alias("has_number"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, pos, v FROM (SELECT l_orderkey, l_linenumber, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, "
    "unnest(a) AS v FROM (SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice, l_discount, l_tax, "
    "CAST(l_linenumber AS DOUBLE), CAST(l_suppkey AS DOUBLE)] AS a FROM lineitem) x) y"
)
def multitask_labels(t: Tables) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
    labels = S.multitask_labels(*[F.col(n) for n in names])
    return t.lineitem.select("l_orderkey", "l_linenumber", F.posexplode(labels).alias("pos", "v"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 7.0::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS v FROM lineitem"
)
def round6(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", S.round6(F.col("l_extendedprice") / 7.0).alias("v")
    )


@query(
    f"SELECT l_orderkey, l_linenumber, l_partkey, {r4('exp((x-m)/1.6::DOUBLE) / sum(exp((x-m)/1.6::DOUBLE)) OVER (PARTITION BY l_orderkey)')} "
    "AS probability FROM (SELECT *, l_quantity/10.0::DOUBLE AS x, max(l_quantity/10.0::DOUBLE) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) s"
)
def softmax_temp(t: Tables) -> DataFrame:
    logits = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 10.0).alias("x"))
    out = measures.softmax_temp(logits, "l_orderkey", "x", K.REFINE_TEMPERATURE)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", n4("probability").alias("probability"))


MEANS_SQL = (
    "SELECT label, list(m ORDER BY pos) AS mean FROM (SELECT label, pos, avg(v) AS m FROM (SELECT label, "
    "generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) e GROUP BY 1, 2) g GROUP BY 1"
)


@query(
    f"WITH means AS ({MEANS_SQL}) SELECT vec_id, "
    + r4("list_distance(embedding::DOUBLE[], mean)")
    + " AS distance, "
    + r4("list_cosine_similarity(embedding::DOUBLE[], mean)")
    + " AS similarity FROM embeddings JOIN means USING (label)"
)
def vector_distance(t: Tables) -> DataFrame:
    means = measures.mean_vector(t.embeddings, ["label"], "embedding", "mean").drop("n")
    joined = t.embeddings.join(means, "label")
    return joined.select(
        "vec_id",
        n4(S.euclidean(F.col("embedding"), F.col("mean"))).alias("distance"),
        n4(S.cosine(F.col("embedding"), F.col("mean"))).alias("similarity"),
    )


@query(
    "SELECT pano, CAST(pos - 1 AS INTEGER) AS pos, " + r4("avg(v)") + " AS v FROM (SELECT vec_id // 4 AS pano, "
    "generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) e GROUP BY 1, 2"
)
def mean_pool_views(t: Tables) -> DataFrame:
    views = t.embeddings.withColumn("pano", F.expr("vec_id div 4"))
    pooled = measures.mean_pool_views(views, "pano")
    return pooled.select("pano", F.posexplode("embedding").alias("pos", "v")).select("pano", "pos", n4("v").alias("v"))


@query("SELECT vec_id, array_to_string([CASE WHEN i = label THEN 1 ELSE 0 END FOR i IN range(10)], '') AS bits FROM embeddings")
def one_hot(t: Tables) -> DataFrame:
    bits = S.one_hot(F.col("label"), 10).cast("array<string>")
    return t.embeddings.select("vec_id", F.array_join(bits, "").alias("bits"))


def _kite(df: DataFrame) -> DataFrame:
    w, h = 1 + F.col("point_id") % 5, 1 + F.col("point_id") % 3
    x, y = F.col("lon"), F.col("lat")
    corners = [(x - w, y), (x, y - h), (x + w, y), (x, y + h), (x - w, y)]
    ring = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners])
    return df.withColumn("ring", ring)


@query(
    "WITH k AS (SELECT point_id, country_id, lat, lon, 1 + point_id % 5 AS w, 1 + point_id % 3 AS h FROM @loc_points) "
    f"SELECT point_id, {r4('lon - w')} AS min_x, {r4('lat + h')} AS max_y, CAST(2 * w * h AS DOUBLE) AS area, {r4('lon')} AS cx, "
    f"{r4('lat')} AS cy, {r4('2.0::DOUBLE * w * h / sum(2.0::DOUBLE * w * h) OVER (PARTITION BY country_id)')} AS fraction FROM k"
)
def polygon_measures(t: Tables) -> DataFrame:
    ring = F.col("ring")
    measured = _kite(t.loc_points).select(
        "point_id",
        "country_id",
        G.ring_bbox(ring).alias("b"),
        G.ring_area(ring).alias("area"),
        G.ring_centroid(ring).alias("c"),
    )
    totals = measured.groupBy("country_id").agg(F.sum("area").alias("total"))
    return measured.join(totals, "country_id").select(
        "point_id",
        n4("b.min_x").alias("min_x"),
        n4("b.max_y").alias("max_y"),
        n4("area").alias("area"),
        n4("c.x").alias("cx"),
        n4("c.y").alias("cy"),
        n4(F.col("area") / F.col("total")).alias("fraction"),
    )


@query(
    "SELECT point_id, CAST(CASE WHEN point_id % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS rings, "
    "CAST(CASE WHEN point_id % 2 = 0 THEN 9 ELSE 14 END AS INTEGER) AS vertices, "
    "CASE WHEN point_id % 2 = 0 THEN 15.5::DOUBLE ELSE 16.5::DOUBLE END AS area FROM @loc_points"
)
def polygon_from_wkt(t: Tables) -> DataFrame:
    """Squares with a hole, alone or followed by a second polygon, written as text and read back."""

    def box(dx: int, size: int):
        x, y = F.col("lon") + dx, F.col("lat")
        corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.format_string("%.3f %.3f", a, b) for a, b in corners]), F.lit(")"))

    hole = F.concat(F.lit("("), F.concat_ws(", ", *[F.format_string("%.3f %.3f", F.col("lon") + a, F.col("lat") + b)
                                                    for a, b in ((1, 1), (2, 1), (2, 2), (1, 1))]), F.lit(")"))
    single = F.concat(F.lit("POLYGON ("), box(0, 4), F.lit(", "), hole, F.lit(")"))
    double = F.concat(F.lit("MULTIPOLYGON (("), box(0, 4), F.lit(", "), hole, F.lit("), ("), box(9, 1), F.lit("))"))
    text = F.when(F.col("point_id") % 2 == 0, single).otherwise(double)
    # A table of points is a small file, which one task reads; texts are written and parsed in many.
    points = t.loc_points.repartition(range_tasks(t.spark), "point_id")
    rings = points.select("point_id", text.alias("text")).select(
        "point_id", G.polygon_from_wkt(F.col("text")).alias("rings")
    )
    areas = F.transform("rings", G.ring_area)
    signed = S.let(areas, lambda each: F.aggregate(each, F.lit(0.0), lambda a, v: a + v) - 2 * F.element_at(each, 2))
    return rings.select(
        "point_id",
        F.size("rings").alias("rings"),
        F.aggregate(F.transform("rings", F.size), F.lit(0), lambda a, v: a + v).alias("vertices"),
        n4(signed).alias("area"),
    )


@query(
    "SELECT point_id, CASE WHEN point_id % 2 = 0 THEN CASE country WHEN 'United Kingdom' THEN 'England' WHEN 'Netherlands' THEN 'Zuid-Holland' ELSE 'NA' END "
    "ELSE coalesce(region, 'none') END AS level1, CASE WHEN point_id % 2 = 0 THEN CASE country WHEN 'United Kingdom' THEN 'England' ELSE 'NA' END "
    "ELSE coalesce(region, 'none') END AS level2 FROM @named_points"
)
def admin_name_repair(t: Tables) -> DataFrame:
    name = F.when(F.col("point_id") % 2 == 0, F.lit("NA")).otherwise(F.coalesce("region", F.lit("none")))
    return t.named_points.select(
        "point_id",
        S.repair_region(F.col("country"), name, 1).alias("level1"),
        S.repair_region(F.col("country"), name, 2).alias("level2"),
    )


@query(
    "SELECT ord, location_id, heading, batch_date, NULL::VARCHAR AS capture_date, NULL::VARCHAR AS pano_id, NULL::DOUBLE AS lat FROM @image_rows"
)
def fill_optional_columns(t: Tables) -> DataFrame:
    filled = S.fill_optional_columns(t.image_rows, K.SNAPSHOT_SCHEMA)
    return filled.select("ord", "location_id", "heading", "batch_date", "capture_date", "pano_id", "lat")


@query(
    f"SELECT point_id, {r4(haversine('lat', 'lon', 'pred_lat', 'pred_lon', K.SCORE_RADIUS_M))} AS km, {SCORE_SQL.format(_KM)} AS score, "
    "left(sha1(unhex(hex('geo:v1:') || " + _INT32.format("lat") + " || " + _INT32.format("lon") + ")), 12) AS location, "
    "CAST(abs((((point_id % 360) - 10 + 180) % 360) - 180) AS DOUBLE) AS turn, "
    f"{_months('printf(chr(37) || chr(48) || chr(50) || chr(100), point_id % 15)')} AS month FROM @guesses"
)
def register_sql_functions(t: Tables) -> DataFrame:
    register_functions(t.spark, "geo_")
    return t.sql(
        "SELECT point_id, rint(geo_haversine_km(lat, lon, pred_lat, pred_lon, 6371000D) * 10000D) / 10000D AS km, "
        "geo_game_score(geo_haversine_km(lat, lon, pred_lat, pred_lon, 6371000D)) AS score, "
        "geo_location_id(lat, lon) AS location, geo_heading_distance(point_id % 360, 10) AS turn, "
        "geo_month_name(concat('2020-', lpad(point_id % 15, 2, '0'))) AS month FROM @guesses"
    )


# ---- filters -----------------------------------------------------------------


@query("SELECT point_id, country FROM @named_points WHERE lower(country) IN ('japan', 'france', 'netherlands')")
def filter_countries(t: Tables) -> DataFrame:
    """The wanted names are those of the points of three residues, written with other case and blanks."""
    padded = F.concat(F.lit("  "), F.upper("country"), F.lit(" ")).alias("name")
    names = t.named_points.where(F.col("point_id") % 7 != 5).where("point_id % 7 NOT IN (3, 4)").select(padded)
    renamed = t.named_points.withColumnRenamed("country", "COUNTRY")
    return tables.filter_countries(renamed, names).select("point_id", F.col("COUNTRY").alias("country"))


@query(
    "SELECT location_id, ord, CAST(tile AS INTEGER) AS tile FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ord) AS tile, "
    "count(*) OVER (PARTITION BY location_id) AS n FROM @image_rows) x WHERE n >= 4 AND tile <= 4"
)
def complete_panoramas(t: Tables) -> DataFrame:
    return tables.complete_panoramas(t.image_rows, "location_id", [F.col("ord")]).select("location_id", "ord", "tile")


@query(
    "SELECT location_id, array_to_string(list(heading ORDER BY heading), ',') AS headings FROM (SELECT DISTINCT ON (location_id, heading) "
    "location_id, heading FROM @image_rows WHERE value >= 20) x GROUP BY 1"
)
def drop_missing_images(t: Tables) -> DataFrame:
    rows = t.image_rows.withColumns(
        {"image": F.when(F.col("value") >= 20, F.col("value")), "lat": F.lit(0.0), "lon": F.lit(0.0)}
    )
    panoramas = tables.build_panoramas(tables.drop_missing_images(rows))
    return panoramas.select("location_id", F.array_join(F.col("headings").cast("array<string>"), ",").alias("headings"))


@query("SELECT ord, location_id FROM @image_rows WHERE location_id IN (SELECT s_suppkey FROM supplier)")
def existing_files(t: Tables) -> DataFrame:
    listing = t.supplier.select(F.col("s_suppkey").alias("location_id"))
    return tables.existing_files(t.image_rows, listing, "location_id").select("ord", "location_id")


@query(
    "SELECT i.event_id, p.lat, p.lon FROM (SELECT event_id, event_id % 700 - 50 AS point_idx FROM events) i "
    "JOIN @members p USING (point_idx) WHERE p.geocell_index <> 3"
)
def valid_indices(t: Tables) -> DataFrame:
    listed = t.events.select("event_id", (F.col("event_id") % 700 - 50).alias("point_idx"))
    broken = F.when(F.col("geocell_index") == 3, F.lit(float("nan"))).otherwise(F.col("lat"))
    points = t.members.select("point_idx", broken.alias("lat"), "lon")
    return tables.valid_indices(listed, points).select("event_id", "lat", "lon")


@query("SELECT location_id, ord, is_new, value FROM @image_rows")
def snapshot_metadata(t: Tables) -> DataFrame:
    return tables.snapshot_metadata(t.image_rows)
