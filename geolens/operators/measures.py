"""Aggregations: cell statistics, vector means, summaries, accuracies, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.functions.scalar import dot, haversine_km, unit_vector
from geolens.operators.spread import global_index, running_total
from geolens.operators.tables import valid_indices


def cell_stats(points: DataFrame, keys: Sequence[str], rollup: bool = False) -> DataFrame:
    """Count, mean position, box and area per cell, or totals for every prefix of the keys."""
    grouped = points.rollup(*keys) if rollup else points.groupBy(*keys)
    lat, lon = F.col("lat"), F.col("lon")
    return grouped.agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg(lat).alias("mean_lat"),
        F.avg(lon).alias("mean_lon"),
        F.min(lat).alias("min_lat"),
        F.max(lat).alias("max_lat"),
        F.min(lon).alias("min_lon"),
        F.max(lon).alias("max_lon"),
        ((F.max(lat) - F.min(lat)) * (F.max(lon) - F.min(lon))).alias("area"),
    )


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str, out: str = "embedding") -> DataFrame:
    """Element-wise mean per key.  Partial sums are kept per map task, one buffer per key."""
    dense = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    means = dense.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"))
    return means.withColumn(out, vector_to_array("_m")).drop("_m")


def mean_pool_views(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    return mean_vector(df, [key], vector, vector).drop("n")


def cluster_centroids(listed: DataFrame) -> DataFrame:
    """Mean position per (geocell, cluster) of attached member points."""
    return listed.groupBy("geocell_index", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon")
    )


def prototype_embeddings(prototypes: DataFrame, members: DataFrame, dim: int) -> DataFrame:
    """Mean member vector per prototype; the zero vector when no member is usable.

    ``prototypes`` lists (geocell_index, cluster_id, indices), ``members`` has one
    or more view vectors per point_idx, with its position.
    """
    views = mean_vector(members, ["point_idx", "lat", "lon"], "embedding").drop("n")
    keys = ["geocell_index", "cluster_id"]
    listed = prototypes.select(*keys, F.explode("indices").alias("point_idx"))
    means = mean_vector(valid_indices(listed, views), keys, "embedding")
    zero = F.array_repeat(F.lit(0.0), dim)
    every = prototypes.select(*keys).distinct().join(means, keys, "left")
    return every.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("embedding", zero).alias("embedding"))


def exact_median(
    df: DataFrame, by: Sequence[str], value: str, name: str = "median", weight: str | None = None
) -> DataFrame:
    """Exact median per group without gathering a group; a row counts ``weight`` times, or once.

    Equal values are counted first; running counts over the ordered values then
    show which values cover the middle positions.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value)
    counts = counts.agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    summed = running_total(counts, by, [F.col(value)], F.col("_n"), "_cum")
    if by:
        placed = summed.join(summed.groupBy(*by).agg(F.sum("_n").alias("_size")), by)
    else:
        placed = summed.withColumn("_size", F.lit(summed.agg(F.sum("_n")).first()[0]).cast("bigint"))
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    first = F.col("_cum") - F.col("_n") + 1
    covers_low = (first <= low) & (low <= F.col("_cum"))
    covers_high = (first <= high) & (high <= F.col("_cum"))
    middle = placed.where(covers_low | covers_high)
    share = covers_low.cast("int") + covers_high.cast("int")
    return middle.groupBy(*by).agg((F.sum(F.col(value) * share) / 2.0).alias(name))


def result_summary(results: DataFrame, by: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """Sample count, mean and median distance, mean top-1 probability, mean score."""
    if check and results.isEmpty():
        raise ValueError("no results to summarise")
    keys = list(by or [])
    means = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.avg(F.coalesce("top1_prob", F.lit(0.0))).alias("avg_top1_prob"),
        F.avg("score").alias("avg_score"),
    )
    medians = exact_median(results, keys, "distance_km", "median_distance_km")
    if keys:
        return means.join(medians, keys)
    return means.withColumn("median_distance_km", F.lit(medians.first()[0]).cast("double"))


def best_worst(results: DataFrame) -> DataFrame:
    """The first smallest and first largest error, with 1-based index and score."""
    nearest_one = results.orderBy(F.col("distance_km"), F.col("idx")).limit(1).withColumn("kind", F.lit("best"))
    farthest = results.orderBy(F.col("distance_km").desc(), F.col("idx")).limit(1).withColumn("kind", F.lit("worst"))
    return nearest_one.unionByName(farthest).select("kind", "idx", "distance_km", "score")


def topk_accuracy(predictions: DataFrame, label: str, ranked: str, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Share of rows whose label is among the first k ranked classes."""
    hits = [F.array_contains(F.slice(F.col(ranked), 1, k), F.col(label)).cast("double") for k in ks]
    return predictions.agg(*[F.avg(hit).alias(f"top{k}_accuracy") for k, hit in zip(ks, hits)])


def log_softmax(logits: DataFrame, key: str = "sample_id") -> DataFrame:
    """Add ``log_prob``; a sample has one row per cell, so its window holds as many rows as there are cells."""
    w = Window.partitionBy(key)
    shifted = F.col("logit") - F.max("logit").over(w)
    return logits.withColumn("log_prob", shifted - F.log(F.sum(F.exp(shifted)).over(w)))


def softmax_temp(df: DataFrame, key: str, logit: str, temperature: float = 1.0, name: str = "probability") -> DataFrame:
    """Softmax per ``key``; the maximum is subtracted, so far-off logits cannot underflow to NaN."""
    w = Window.partitionBy(key)
    weight = F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)
    return df.withColumn("_w", weight).withColumn(name, F.col("_w") / F.sum("_w").over(w)).drop("_w")


def soft_label_loss(
    logits: DataFrame, truth: DataFrame, cells: DataFrame, tau_km: float = K.LABEL_SMOOTHING_KM
) -> DataFrame:
    """Mean cross entropy against labels smoothed by distance to the cell centroids: (n, loss, n_missing).

    For logits at hand; from vectors and weights, ``predict.soft_head_loss`` never makes rows of sample and class.

    Probabilities are over all classes; one without centroid has no weight in the label.  A sample without truth, or
    none of whose classes has a centroid, has no loss: it counts in ``n`` and in ``n_missing``.
    """
    w = Window.partitionBy("sample_id")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"), K.LABEL_RADIUS_M)
    joined = log_softmax(logits).join(cells.select("geocell_index", "clat", "clon"), "geocell_index", "left")
    joined = joined.join(truth.select("sample_id", "lat", "lon"), "sample_id", "left")
    known = F.lit(True)
    for name in ("lat", "lon", "clat", "clon"):  # a NaN would pass as the antipode: least(1, NaN) is 1
        known = known & F.col(name).isNotNull() & ~F.isnan(name)
    joined = joined.withColumn("km", F.when(known, km))
    raw = F.exp(-(F.col("km") - F.min("km").over(w)) / tau_km)
    weighted = joined.withColumn("w", F.coalesce(raw, F.lit(0.0)))
    loss = -F.sum(F.when(F.col("w") > 0, F.col("w") * F.col("log_prob"))) / F.greatest(F.sum("w"), F.lit(1e-12))
    return mean_loss(weighted.groupBy("sample_id").agg(F.when(F.count("km") > 0, loss).alias("loss")))


def hard_label_loss(logits: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean cross entropy against the class index: (n, loss, n_missing).  From vectors: ``predict.hard_head_loss``.

    A sample without label, or whose label is no class, has no loss: it counts in ``n`` and in ``n_missing``.
    """
    named = log_softmax(logits).join(labels.select("sample_id", "label"), "sample_id", "left")
    own = F.max(F.when(F.col("geocell_index") == F.col("label"), F.col("log_prob")))
    return mean_loss(named.groupBy("sample_id").agg((-own).alias("loss")))


def mean_loss(per_sample: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return per_sample.agg(n.alias("n"), F.avg("loss").alias("loss"), (n - F.count("loss")).alias("n_missing"))


def retrieval_accuracy(left: DataFrame, right: DataFrame, batch_size: int, trials: int | None = None) -> DataFrame:
    """Share of rows whose most similar partner in their batch, by cosine, is their own.

    A batch is ``batch_size`` consecutive ids; the last one may be shorter.  A row
    without partner is a miss.  ``trials`` looks at the first batches only.  The
    partners of a batch travel as one array, so rows are joined once each rather
    than pair by pair.
    """
    rows = global_index(left.select("id", unit_vector(F.col("embedding")).alias("embedding")), [F.col("id")], "at")
    rows = rows.withColumn("batch", F.floor(F.col("at") / batch_size))
    if trials is not None:
        rows = rows.where(F.col("batch") < trials)
    partners = rows.select("id", "at", "batch").join(
        right.select("id", unit_vector(F.col("embedding")).alias("partner")), "id"
    )
    packed = partners.groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct("at", "partner"))).alias("partners")
    )
    scores = F.transform("partners", lambda p: dot(F.col("embedding"), p["partner"]))
    best = F.element_at("partners", F.array_position(F.col("scores"), F.array_max("scores")).cast("int"))["at"]
    matched = rows.join(packed, "batch", "left").withColumn("scores", scores)
    hit = F.coalesce(best == F.col("at"), F.lit(False)).cast("double")
    by_batch = matched.groupBy("batch").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return by_batch.agg(F.count(F.lit(1)).alias("trials"), F.try_divide(F.sum("hits"), F.sum("n")).alias("accuracy"))


def conversion_rate(
    candidates: DataFrame, covered: str, by: Sequence[str] | None = None, target: int | None = None
) -> DataFrame:
    """Covered share of the candidates in percent, and candidates needed for a target."""
    grouped = candidates.groupBy(*by) if by else candidates
    n, hits = F.count(F.lit(1)), F.sum(F.col(covered).cast("bigint"))
    out = grouped.agg(n.alias("candidates"), F.coalesce(hits, F.lit(0)).alias("covered"))
    return with_rate(out, target)


def with_rate(counts: DataFrame, target: int | None = None) -> DataFrame:
    """``candidates`` and ``covered`` with their rate in percent, and the candidates a target needs."""
    rate = F.coalesce(F.try_divide(F.col("covered") * 100.0, F.col("candidates")), F.lit(0.0))
    out = counts.withColumn("rate", rate)
    if target is not None:
        out = out.withColumn("needed", F.ceil(F.try_divide(F.lit(target * 100.0), F.col("rate"))))
    return out


def map_center(points: DataFrame, default: tuple[float, float] = (60.0, 15.0)) -> DataFrame:
    return points.agg(
        F.coalesce(F.avg("lat"), F.lit(default[0])).alias("lat"),
        F.coalesce(F.avg("lon"), F.lit(default[1])).alias("lon"),
        F.count(F.lit(1)).alias("n"),
    )


def refine_change_rate(refined: DataFrame) -> DataFrame:
    changed = (F.col("candidate") != 0).cast("double")
    return refined.agg((F.avg(changed) * 100.0).alias("changed_percent"))


def binary_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve; NaN when only one class is present.

    Equal scores are counted together first, which settles ties and keeps the
    ordered pass as small as the number of distinct scores.
    """
    positive = F.sum(F.when(F.col(y) == 1, 1).otherwise(0))
    tied = df.groupBy(score).agg(positive.alias("pos"), (F.count(F.lit(1)) - positive).alias("neg"))
    summed = running_total(tied, [], [F.col(score)], F.col("neg"), "neg_upto")
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return summed.agg(F.when(pairs > 0, wins / pairs).otherwise(F.lit(float("nan"))).alias("auc"))
