"""Queries over vectors, predictions, losses and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions import scalar as S
from geolens.operators import measures, predict, tables
from geolens.plans.scalar_queries import MEANS_SQL, SCORE_SQL, n4
from geolens.plans.views import Tables, haversine, oracle, r4
from geolens.session import cut_lineage

QUERIES, ORACLES = {}, {}
DIM = 64


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = oracle(sql)
        return fn

    return add


# ---- prototypes --------------------------------------------------------------


@query(
    f"SELECT geocell_index, cluster_id, count(*) AS n, {r4('avg(lat)')} AS centroid_lat, {r4('avg(lon)')} AS centroid_lon FROM @members GROUP BY 1, 2"
)
def cluster_centroids(t: Tables) -> DataFrame:
    listed = tables.attach_by_index(member_lists(t), t.members.select("point_idx", "lat", "lon"))
    out = measures.cluster_centroids(listed)
    return out.withColumns({c: n4(c) for c in ("centroid_lat", "centroid_lon")})


def member_lists(t: Tables) -> DataFrame:
    """Id lists of at most 64 members each per (geocell, cluster)."""
    chunks = t.members.groupBy("geocell_index", "cluster_id", F.expr("point_idx div 64").alias("chunk"))
    return chunks.agg(F.collect_list("point_idx").alias("indices"))


PROTO_SQL = (
    "SELECT geocell_index, cluster_id, list(m ORDER BY pos) AS embedding, any_value(n) AS n FROM (SELECT geocell_index, cluster_id, pos, avg(v) AS m, count(*) AS n FROM "
    "(SELECT geocell_index, cluster_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM @members WHERE geocell_index <> 4) e GROUP BY 1, 2, 3) g GROUP BY 1, 2"
)


@query(
    "SELECT geocell_index, cluster_id, CAST(pos - 1 AS INTEGER) AS pos, count(*) FILTER (WHERE geocell_index <> 4) AS n, "
    + r4("coalesce(avg(v) FILTER (WHERE geocell_index <> 4), 0.0::DOUBLE)")
    + " AS v FROM (SELECT geocell_index, cluster_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM @members) e GROUP BY 1, 2, 3"
)
def prototype_embeddings(t: Tables) -> DataFrame:
    """The members of cell 4 have no usable position, so its prototypes are zero vectors."""
    lat = F.when(F.col("geocell_index") == 4, F.lit(float("nan"))).otherwise(F.col("lat"))
    members = t.members.select("point_idx", lat.alias("lat"), "lon", "embedding")
    out = measures.prototype_embeddings(member_lists(t), members, DIM)
    rows = out.select("geocell_index", "cluster_id", "n", F.posexplode("embedding").alias("pos", "v"))
    return rows.withColumn("v", n4("v"))


# ---- linear head -------------------------------------------------------------

_W = f"w AS (SELECT CAST(label AS BIGINT) AS geocell_index, mean AS weight, label / 100.0::DOUBLE AS bias FROM ({MEANS_SQL}) m)"
_LOGITS = (
    "lg AS (SELECT vec_id AS sample_id, w.geocell_index, list_dot_product(embedding::DOUBLE[], weight) + bias AS logit FROM embeddings, w)"
)
_PROBS = (
    "pr AS (SELECT *, exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY sample_id) AS probability FROM "
    "(SELECT *, max(logit) OVER (PARTITION BY sample_id) AS mx FROM lg) z), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY probability DESC, geocell_index) - 1 AS candidate FROM pr)"
)
HEAD_SQL = f"{_W}, {_LOGITS}, {_PROBS}"


def head_weights(t: Tables) -> DataFrame:
    """Class weights: the mean vector of each label, with a small bias."""
    means = measures.mean_vector(t.embeddings, ["label"], "embedding", "weight").drop("n")
    return means.select(F.col("label").alias("geocell_index"), "weight", (F.col("label") / 100.0).alias("bias"))


def scored(t: Tables, k: int = 5) -> DataFrame:
    return predict.score_linear_head(t.samples, head_weights(t), t.cells, DIM, k)


@query(
    f"WITH {HEAD_SQL} SELECT sample_id, r.geocell_index, {r4('probability')} AS probability, clat AS pred_lat, clon AS pred_lon FROM rk r JOIN @cells c ON c.geocell_index = r.geocell_index WHERE candidate = 0"
)
def score_linear_head(t: Tables) -> DataFrame:
    best = F.col("candidates")[0]["probability"]
    return scored(t).select("sample_id", "geocell_index", n4(best).alias("probability"), "pred_lat", "pred_lon")


@query(f"WITH {HEAD_SQL} SELECT sample_id, geocell_index, candidate, {r4('probability')} AS probability FROM rk WHERE candidate < 5")
def topk_candidates(t: Tables) -> DataFrame:
    out = predict.candidate_rows(scored(t, 5))
    return out.select(
        "sample_id", "geocell_index", F.col("candidate").cast("bigint").alias("candidate"), n4("probability").alias("probability")
    )


@query(
    f"WITH {HEAD_SQL} SELECT avg(CAST(candidate = 0 AS INTEGER)) AS top1_accuracy, avg(CAST(candidate < 5 AS INTEGER)) AS top5_accuracy FROM rk JOIN @samples s USING (sample_id) WHERE s.true_cell = rk.geocell_index"
)
def topk_accuracy(t: Tables) -> DataFrame:
    ranked = F.transform("candidates", lambda c: c["geocell_index"])
    joined = scored(t).join(t.samples.select("sample_id", "true_cell"), "sample_id").withColumn("ranked", ranked)
    return measures.topk_accuracy(joined, "true_cell", "ranked")


_LSM = "ls AS (SELECT *, logit - mx - ln(sum(exp(logit - mx)) OVER (PARTITION BY sample_id)) AS lp FROM (SELECT *, max(logit) OVER (PARTITION BY sample_id) AS mx FROM lg) z)"
_SOFT_KM = haversine("s.lat", "s.lon", "c.clat", "c.clon", K.LABEL_RADIUS_M)


@query(
    f"WITH {_W}, {_LOGITS}, {_LSM}, d AS (SELECT ls.sample_id, lp, {_SOFT_KM} AS km FROM ls JOIN @samples s USING (sample_id) JOIN @cells c ON c.geocell_index = ls.geocell_index), "
    "e AS (SELECT *, exp(-(km - min(km) OVER (PARTITION BY sample_id)) / 65.0::DOUBLE) AS w FROM d) "
    f"SELECT count(*) AS n, {r4('avg(loss)')} AS loss FROM (SELECT sample_id, -sum(w*lp)/greatest(sum(w), 1e-12::DOUBLE) AS loss FROM e GROUP BY 1) f"
)
def soft_label_loss(t: Tables) -> DataFrame:
    out = predict.soft_head_loss(t.samples, head_weights(t), t.cells, DIM)
    return out.select("n", n4("loss").alias("loss"))


@query(
    f"WITH {_W}, {_LOGITS}, {_LSM} SELECT count(*) AS n, {r4('avg(-lp)')} AS loss FROM ls JOIN @samples s USING (sample_id) WHERE s.true_cell = ls.geocell_index"
)
def hard_label_loss(t: Tables) -> DataFrame:
    out = predict.hard_head_loss(t.samples.select("sample_id", "embedding", F.col("true_cell").alias("label")), head_weights(t), DIM)
    return out.select("n", n4("loss").alias("loss"))


@query(
    f"WITH m AS ({MEANS_SQL}), r AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) - 1 AS at_, label FROM embeddings), "
    "p AS (SELECT r.*, list_transform(list_zip(r.e, m.mean), lambda x: x[1]*0.5::DOUBLE + x[2]) AS partner FROM r JOIN m USING (label)), "
    "b AS (SELECT a.at_ // 30 AS batch, a.at_ AS i, q.at_ AS j, list_dot_product(a.e, q.partner) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(q.partner, q.partner))) AS s FROM p a JOIN p q ON a.at_ // 30 = q.at_ // 30), "
    "k AS (SELECT batch, i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS n FROM b) "
    f"SELECT count(DISTINCT batch) AS trials, {r4('avg(CAST(i = j AS INTEGER))')} AS accuracy FROM k WHERE n = 1"
)
def retrieval_accuracy(t: Tables) -> DataFrame:
    """Partner vectors: half the own vector plus the mean of the label.  The last batch is a short one."""
    left = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    means = measures.mean_vector(t.embeddings, ["label"], "embedding", "mean").drop("n")
    partner = F.zip_with("embedding", "mean", lambda a, b: a.cast("double") * 0.5 + b)
    right = left.join(means, "label").select("id", partner.alias("embedding"))
    out = measures.retrieval_accuracy(left, right, 30)
    return out.select("trials", n4("accuracy").alias("accuracy"))


# ---- prototype refinement ----------------------------------------------------


def prototypes(t: Tables) -> DataFrame:
    """Mean vector and position per cluster; cell 4 has none."""
    members = t.members.where("geocell_index <> 4")
    keys = ["geocell_index", "cluster_id"]
    where = members.groupBy(*keys).agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))
    return measures.mean_vector(members, keys, "embedding").join(where, keys)


def candidates(t: Tables, k: int = 5) -> DataFrame:
    return predict.candidate_rows(scored(t, k))


_PROTOS = (
    "pt AS (SELECT p.*, lat AS centroid_lat, lon AS centroid_lon FROM (" + PROTO_SQL + ") p JOIN (SELECT geocell_index, cluster_id, avg(lat) AS lat, avg(lon) AS lon FROM @members GROUP BY 1, 2) c USING (geocell_index, cluster_id))"
)
_J15 = (
    "pd AS (SELECT k.sample_id, k.candidate, k.geocell_index, k.probability, pt.cluster_id, round(list_distance(s.embedding::DOUBLE[], pt.embedding), 9) AS gap, centroid_lat, centroid_lon "
    "FROM rk k JOIN @samples s USING (sample_id) LEFT JOIN pt USING (geocell_index) WHERE k.candidate < 5), "
    "np AS (SELECT sample_id, candidate, geocell_index, probability, cluster_id, coalesce(-gap, -100000.0::DOUBLE) AS logit, coalesce(centroid_lat, 0.0::DOUBLE) AS centroid_lat, "
    "coalesce(centroid_lon, 0.0::DOUBLE) AS centroid_lon FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, candidate ORDER BY gap, cluster_id) AS n FROM pd) z WHERE n = 1)"
)


@query(f"WITH {HEAD_SQL}, {_PROTOS}, {_J15} SELECT sample_id, candidate, geocell_index, cluster_id, {r4('logit')} AS logit, {r4('centroid_lat')} AS lat, {r4('centroid_lon')} AS lon FROM np")
def nearest_prototype(t: Tables) -> DataFrame:
    out = predict.nearest_prototype(t.samples, candidates(t), prototypes(t))
    return out.select(
        "sample_id",
        F.col("candidate").cast("bigint").alias("candidate"),
        "geocell_index",
        "cluster_id",
        n4("logit").alias("logit"),
        n4("centroid_lat").alias("lat"),
        n4("centroid_lon").alias("lon"),
    )


def _member_sql(order: str) -> str:
    return (
        "md AS (SELECT np.sample_id, np.candidate, m.point_idx, m.lat, m.lon, round(list_distance(s.embedding::DOUBLE[], m.embedding::DOUBLE[]), 9) AS gap FROM np JOIN @samples s USING (sample_id) "
        "JOIN @members m ON m.geocell_index = np.geocell_index AND m.cluster_id = np.cluster_id WHERE np.cluster_id <> 2), "
        f"nm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, candidate ORDER BY gap {order}, point_idx) AS n FROM md) z WHERE n = 1)"
    )


def _members(t: Tables) -> DataFrame:
    """Clusters numbered 2 have lost their members."""
    return t.members.where("cluster_id <> 2")


@query(
    f"WITH {HEAD_SQL}, {_PROTOS}, {_J15}, {_member_sql('')} SELECT np.sample_id, np.candidate, point_idx, {r4('coalesce(nm.lat, centroid_lat)')} AS lat, "
    f"{r4('coalesce(nm.lon, centroid_lon)')} AS lon FROM np LEFT JOIN nm USING (sample_id, candidate)"
)
def nearest_member(t: Tables) -> DataFrame:
    clusters = predict.nearest_prototype(t.samples, candidates(t), prototypes(t))
    out = predict.nearest_member(t.samples, clusters, _members(t))
    return _placed(out)


@query(
    f"WITH {HEAD_SQL}, {_PROTOS}, {_J15}, {_member_sql('DESC')} SELECT np.sample_id, np.candidate, point_idx, {r4('coalesce(nm.lat, centroid_lat)')} AS lat, "
    f"{r4('coalesce(nm.lon, centroid_lon)')} AS lon FROM np LEFT JOIN nm USING (sample_id, candidate)"
)
def farthest_member(t: Tables) -> DataFrame:
    clusters = predict.nearest_prototype(t.samples, candidates(t), prototypes(t))
    return _placed(predict.nearest_member(t.samples, clusters, _members(t), pick="farthest"))


def _placed(out: DataFrame) -> DataFrame:
    return out.select(
        "sample_id",
        F.col("candidate").cast("bigint").alias("candidate"),
        "point_idx",
        n4("lat").alias("lat"),
        n4("lon").alias("lon"),
    )


_REFINE = (
    f"{HEAD_SQL}, {_PROTOS}, {_J15}, {_member_sql('')}, "
    "pl AS (SELECT np.*, coalesce(nm.lat, centroid_lat) AS lat, coalesce(nm.lon, centroid_lon) AS lon FROM np LEFT JOIN nm USING (sample_id, candidate)), "
    "sm AS (SELECT *, probability * e / sum(e) OVER (PARTITION BY sample_id) AS f FROM (SELECT *, exp((logit - max(logit) OVER (PARTITION BY sample_id)) / 1.6::DOUBLE) AS e FROM pl) z), "
    "pk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY f DESC, candidate) AS nr, row_number() OVER (PARTITION BY sample_id ORDER BY probability DESC, candidate) AS ni FROM sm), "
    f"fa AS (SELECT sample_id, {haversine('c.clat', 'c.clon', 'pk.lat', 'pk.lon', K.LABEL_RADIUS_M)} > 1000.0 AS far FROM pk JOIN rk k USING (sample_id) JOIN @cells c ON c.geocell_index = k.geocell_index WHERE pk.nr = 1 AND k.candidate = 0), "
    "rf AS (SELECT pk.* FROM pk JOIN fa USING (sample_id) WHERE (far AND ni = 1) OR (NOT far AND nr = 1))"
)


def refined(t: Tables) -> DataFrame:
    """Initial predictions are the centroids of the best class; samples are scored once."""
    head = cut_lineage(scored(t))
    samples = t.samples.join(
        head.select("sample_id", F.col("pred_lat").alias("init_lat"), F.col("pred_lon").alias("init_lon")), "sample_id"
    )
    return predict.refine_prediction(samples, predict.candidate_rows(head), prototypes(t), _members(t))


@query(f"WITH {_REFINE} SELECT sample_id, CAST(candidate AS INTEGER) AS candidate, geocell_index, {r4('lat')} AS lat, {r4('lon')} AS lon, {r4('f')} AS weight FROM rf")
def refine_prediction(t: Tables) -> DataFrame:
    out = refined(t)
    return out.withColumns({c: n4(c) for c in ("lat", "lon", "weight")})


@query(f"WITH {_REFINE} SELECT {r4('avg(CAST(candidate <> 0 AS INTEGER)) * 100')} AS changed_percent FROM rf")
def refine_change_rate(t: Tables) -> DataFrame:
    return measures.refine_change_rate(refined(t)).select(n4("changed_percent").alias("changed_percent"))


# ---- evaluation --------------------------------------------------------------

_EVAL_KM = haversine("s.lat", "s.lon", "c.clat", "c.clon", K.SCORE_RADIUS_M)
EVAL_SQL = (
    f"{HEAD_SQL}, ev AS (SELECT s.sample_id, s.true_cell, k.geocell_index AS pred_cell, probability, {_EVAL_KM} AS km, c.clat, c.clon FROM rk k JOIN @samples s USING (sample_id) "
    "JOIN @cells c ON c.geocell_index = k.geocell_index WHERE candidate = 0)"
)
_META = "SELECT geocell_index, 'land ' || admin0 AS country, 'area ' || geocell_index AS admin1 FROM @cells WHERE geocell_index <> 6"


def cell_names(t: Tables) -> DataFrame:
    return t.cells.where("geocell_index <> 6").select(
        "geocell_index",
        F.concat(F.lit("land "), F.col("admin0").cast("string")).alias("country"),
        F.concat(F.lit("area "), F.col("geocell_index").cast("string")).alias("admin1"),
    )


@query(
    f"WITH {EVAL_SQL}, mt AS ({_META}), tp AS (SELECT sample_id, string_agg(k.geocell_index || ':' || coalesce(country, '?') || ':' || coalesce(admin1, '?'), ';' ORDER BY candidate) AS top5 "
    "FROM rk k LEFT JOIN mt USING (geocell_index) WHERE candidate < 5 GROUP BY 1) "
    f"SELECT sample_id, true_cell, clat AS pred_lat, {r4('km')} AS distance_km, {SCORE_SQL.format('km')} AS score, top5 FROM ev JOIN tp USING (sample_id)"
)
def evaluate(t: Tables) -> DataFrame:
    results, _ = predict.evaluate(scored(t), t.samples, cell_names(t))
    text = F.transform(
        "top5_geocells",
        lambda c: F.concat_ws(":", c["geocell_index"].cast("string"), c["country"], c["admin1"]),
    )
    return results.select(
        "sample_id",
        "true_cell",
        F.col("prediction.lat").alias("pred_lat"),
        n4("distance_km").alias("distance_km"),
        "score",
        F.array_join(text, ";").alias("top5"),
    )


_SUMMARY = (
    "count(*) AS num_samples, "
    f"{r4('avg(km)')} AS avg_distance_km, {r4('median(km)')} AS median_distance_km, {r4('avg(probability)')} AS avg_top1_prob, {r4('avg(score)')} AS avg_score"
)
_SUMMARY_COLUMNS = ("avg_distance_km", "median_distance_km", "avg_top1_prob", "avg_score")


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "num_samples", *[n4(c).alias(c) for c in _SUMMARY_COLUMNS])


@query(f"WITH {EVAL_SQL} SELECT {_SUMMARY} FROM (SELECT *, {SCORE_SQL.format('km')} AS score FROM ev) z")
def evaluate_summary(t: Tables) -> DataFrame:
    _, summary = predict.evaluate(scored(t), t.samples, cell_names(t))
    return _summary(summary)


_GUESS_KM = haversine("lat", "lon", "pred_lat", "pred_lon", K.SCORE_RADIUS_M)


def guess_results(t: Tables) -> DataFrame:
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.col("pred_lat"), F.col("pred_lon"))
    return t.guesses.withColumn("distance_km", km).withColumn("score", S.game_score(F.col("distance_km")))


@query(
    f"SELECT {_SUMMARY} FROM (SELECT *, top1_prob AS probability, {SCORE_SQL.format('km')} AS score FROM (SELECT *, {_GUESS_KM} AS km FROM @guesses) y) z"
)
def result_summary(t: Tables) -> DataFrame:
    return _summary(measures.result_summary(guess_results(t)))


@query(
    f"SELECT country_id, {_SUMMARY} FROM (SELECT *, top1_prob AS probability, {SCORE_SQL.format('km')} AS score FROM (SELECT *, {_GUESS_KM} AS km FROM @guesses) y) z GROUP BY 1"
)
def result_summary_by_country(t: Tables) -> DataFrame:
    return _summary(measures.result_summary(guess_results(t), ["country_id"]), "country_id")


@query(
    f"WITH g AS (SELECT point_id + 1 AS idx, {_GUESS_KM} AS km FROM @guesses), h AS (SELECT *, {SCORE_SQL.format('km')} AS score FROM g) "
    f"SELECT kind, idx, {r4('km')} AS distance_km, score FROM (SELECT 'best' AS kind, *, row_number() OVER (ORDER BY km, idx) AS n FROM h UNION ALL "
    "SELECT 'worst', *, row_number() OVER (ORDER BY km DESC, idx) FROM h) x WHERE n = 1"
)
def best_worst(t: Tables) -> DataFrame:
    out = measures.best_worst(guess_results(t).withColumn("idx", F.col("point_id") + 1))
    return out.select("kind", "idx", n4("distance_km").alias("distance_km"), "score")


@query(
    f"SELECT country_id, candidates, covered, {r4('rate')} AS rate, CAST(ceil(4000.0::DOUBLE / nullif(rate, 0) * 100) AS BIGINT) AS needed FROM "
    "(SELECT country_id, count(*) AS candidates, CAST(sum(CAST(lat > 0 AND country_id <> 9 AS INTEGER)) AS BIGINT) AS covered, "
    "sum(CAST(lat > 0 AND country_id <> 9 AS INTEGER)) * 100.0::DOUBLE / count(*) AS rate FROM @loc_points GROUP BY 1) x"
)
def conversion_rate(t: Tables) -> DataFrame:
    flagged = t.loc_points.withColumn("covered", (F.col("lat") > 0) & (F.col("country_id") != 9))
    out = measures.conversion_rate(flagged, "covered", ["country_id"], 4000)
    return out.withColumn("rate", n4("rate"))


@query(f"SELECT {r4('avg(lat)')} AS lat, {r4('avg(lon)')} AS lon, count(*) AS n FROM @loc_points")
def map_center(t: Tables) -> DataFrame:
    return measures.map_center(t.loc_points).select(n4("lat").alias("lat"), n4("lon").alias("lon"), "n")


@query(
    "WITH r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2.0::DOUBLE AS r FROM @scored) "
    f"SELECT {r4('(sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y)*(sum(y)+1)/2.0::DOUBLE) / (sum(y)*(count(*)-sum(y)))')} AS auc FROM r"
)
def binary_auc(t: Tables) -> DataFrame:
    return measures.binary_auc(t.scored, "y", "score").select(n4("auc").alias("auc"))
