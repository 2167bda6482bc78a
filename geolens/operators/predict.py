"""From embeddings to coordinates: class scores, candidates, prototype refinement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geolens import constants as K
from geolens.functions.scalar import game_score, haversine_km
from geolens.operators.measures import mean_loss, result_summary
from geolens.operators.spread import global_index, top_per_key
from geolens.session import cut_lineage

# Packs of class weights and chunks of samples that meet in one task stay about below these sizes.
BLOCK_BYTES = 32 * 1024 * 1024
CHUNK_BYTES = 64 * 1024 * 1024
# Samples and classes of one matrix product inside a meeting.
STEP_SAMPLES = 4096
STEP_CLASSES = 512
# Blocks of queries and items that meet in one task when nearest vectors are searched.
CHUNK_SIZE = 4096
PACK_SIZE = 1024


# ---- linear head -------------------------------------------------------------


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a matrix; a null vector or component is NaN, another length an error."""
    column = column.combine_chunks()
    known = column.is_valid()
    out = np.full((len(column), dim), np.nan)
    if pc.any(pc.not_equal(pc.list_value_length(column), dim)).as_py():
        raise ValueError(f"a vector has not {dim} components")
    out[known.to_numpy(zero_copy_only=False)] = column.filter(known).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _meetings(samples: DataFrame, weights: DataFrame, dim: int, per_chunk: int, per_pack: int, match, schema: T.StructType):
    """(states, number of packs): ``match`` of every chunk of samples and every pack of classes, one meeting a group.

    Packs and chunks are numbered by hashes and their numbers come from counts, so nothing of either side passes the
    driver.  A head that fits into one pack, the usual case, sends each sample through the shuffle once.  A class
    without id or weights is none; one without bias has none.
    """
    weights = weights.where(F.col("geocell_index").isNotNull() & F.col("weight").isNotNull())
    classes = cut_lineage(weights.withColumn("bias", F.coalesce(F.col("bias").cast("double"), F.lit(0.0))))
    packs = max(1, -(-classes.count() // per_pack))
    samples = samples.withColumn("_row", F.monotonically_increasing_id() if packs > 1 else F.lit(0).cast("bigint"))
    if packs > 1:
        samples = cut_lineage(samples)  # row numbers that hold for every pack, whoever reads them again
    chunks = max(1, -(-samples.count() // per_chunk))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = samples.withColumn("_chunk", F.pmod(F.xxhash64("sample_id", "embedding"), F.lit(chunks)).cast("int"))
    left = left.withColumn("_pack", numbers(packs)) if packs > 1 else left.withColumn("_pack", F.lit(0))
    right = classes.withColumn("_pack", F.pmod(F.xxhash64("geocell_index"), F.lit(packs)).cast("int"))
    right = right.withColumn("_chunk", numbers(chunks)) if chunks > 1 else right.withColumn("_chunk", F.lit(0))

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.Table.from_pylist([], schema=to_arrow_schema(schema))
        theirs = theirs.sort_by("geocell_index")
        columns = match(mine, theirs)
        return pa.table([columns[f.name] for f in schema], schema=to_arrow_schema(schema))

    keys = ["_chunk", "_pack"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema), packs


def class_logits(samples: DataFrame, weights: DataFrame, dim: int) -> DataFrame:
    """One row (sample_id, geocell_index, logit) per sample and class, for those who want them all.

    Candidates and losses don't need these rows: see ``class_states``.  A sample without vector has NULL logits.
    """
    fields = [samples.schema["sample_id"], T.StructField("geocell_index", T.LongType()), T.StructField("logit", T.DoubleType())]

    def match(mine: pa.Table, theirs: pa.Table) -> dict:
        logits = _vectors(mine.column("embedding"), dim) @ _vectors(theirs.column("weight"), dim).T + _floats(theirs, "bias")
        n, c = logits.shape
        return {
            "sample_id": mine.column("sample_id").take(pa.array(np.repeat(np.arange(n), c))),
            "geocell_index": theirs.column("geocell_index").cast(pa.int64()).take(pa.array(np.tile(np.arange(c), n))),
            "logit": pa.array(logits.ravel(), from_pandas=True),
        }

    samples, weights = samples.select("sample_id", "embedding"), weights.select("geocell_index", "weight", "bias")
    return _meetings(samples, weights, dim, CHUNK_SIZE, PACK_SIZE, match, T.StructType(fields))[0]


class _State:
    """What scores of classes seen so far leave behind for each of ``n`` samples; classes come in ascending order."""

    def __init__(self, n: int, k: int):
        self.peak, self.total, self.own = np.full(n, -np.inf), np.zeros(n), np.full(n, np.nan)
        self.top, self.index = np.empty((n, 0)), np.empty((n, 0), np.int64)
        self.near, self.share, self.shared = np.full(n, np.inf), np.zeros(n), np.zeros(n)
        self.k = k

    def scores(self, logits: np.ndarray, index: np.ndarray) -> None:
        peak = np.maximum(self.peak, logits.max(axis=1))
        floor = np.where(np.isneginf(peak), 0.0, peak)
        self.total = self.total * np.exp(self.peak - floor) + np.exp(logits - floor[:, None]).sum(axis=1)
        self.peak = peak
        if self.k:
            every = np.concatenate((self.top, logits), axis=1)
            named = np.concatenate((self.index, np.broadcast_to(index, logits.shape)), axis=1)
            best = np.argsort(-every, axis=1, kind="stable")[:, : self.k]  # equal scores: the lower class
            self.top, self.index = np.take_along_axis(every, best, 1), np.take_along_axis(named, best, 1)

    def label(self, logits: np.ndarray, index: np.ndarray, label: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(index, label), len(index) - 1)
        hit = np.flatnonzero(index[at] == label)
        self.own[hit] = logits[hit, at[hit]]

    def truth(self, logits: np.ndarray, km: np.ndarray, tau: float) -> None:
        """``km`` to the classes' centroids; infinite where one of the two is unknown."""
        near = np.minimum(self.near, km.min(axis=1))
        base = np.where(np.isinf(near), 0.0, near)
        weight = np.exp(-(km - base[:, None]) / tau)
        fade = np.exp(-(self.near - base) / tau)
        self.share = self.share * fade + weight.sum(axis=1)
        self.shared = self.shared * fade + np.where(weight > 0, weight * logits, 0.0).sum(axis=1)
        self.near = near


def _km(lat: np.ndarray, lon: np.ndarray, clat: np.ndarray, clon: np.ndarray) -> np.ndarray:
    """Great-circle distances of all of the one to all of the other; infinite where a coordinate is unknown."""
    lat, lon, clat, clon = (np.radians(x) for x in (lat[:, None], lon[:, None], clat[None, :], clon[None, :]))
    a = np.sin((clat - lat) / 2) ** 2 + np.cos(lat) * np.cos(clat) * np.sin((clon - lon) / 2) ** 2
    km = 2.0 * K.LABEL_RADIUS_M / 1000.0 * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
    return np.where(np.isnan(km), np.inf, km)


def class_states(
    samples: DataFrame, weights: DataFrame, dim: int, k: int = 0, cells: DataFrame | None = None, tau_km: float = K.LABEL_SMOOTHING_KM
) -> DataFrame:
    """One row per sample: what its scores of all classes come to, never the scores themselves.

    ``peak`` and ``total`` (sum of exp(logit - peak)) give every probability; ``top`` holds the k best
    (logit, geocell_index).  With a column ``label``, ``own`` is the logit of that class.  With ``cells`` and columns
    lat and lon, ``near`` is the distance to the nearest centroid, and ``share`` and ``shared`` are the sums of the
    smoothed label's weights and of weights times logits.  States of the packs of a large head are merged by sample.
    All are NULL, ``top`` empty, for a sample without vector or when there are no classes.
    """
    labelled, placed = "label" in samples.columns, cells is not None
    samples = samples.select("sample_id", "embedding", *(["label"] if labelled else []), *(["lat", "lon"] if placed else []))
    weights = weights.select("geocell_index", "weight", "bias")
    if placed:
        weights = weights.join(cells.select("geocell_index", "clat", "clon"), "geocell_index", "left")
    numbers = ["peak", "total", "own", "near", "share", "shared"]
    fields = [samples.schema["sample_id"], T.StructField("_row", T.LongType())]
    fields += [T.StructField(n, T.DoubleType()) for n in numbers]
    fields += [T.StructField("_logits", T.ArrayType(T.DoubleType())), T.StructField("_classes", T.ArrayType(T.LongType()))]

    def match(mine: pa.Table, theirs: pa.Table) -> dict:
        index = theirs.column("geocell_index").cast(pa.int64()).to_numpy()
        weight, bias = _vectors(theirs.column("weight"), dim), _floats(theirs, "bias")
        found: dict[str, list] = {n: [] for n in (*numbers, "_logits", "_classes")}
        for begin in range(0, mine.num_rows, STEP_SAMPLES):
            part = mine.slice(begin, STEP_SAMPLES)
            x, state = _vectors(part.column("embedding"), dim), _State(part.num_rows, k)
            for c in range(0, len(index), STEP_CLASSES):
                of = slice(c, c + STEP_CLASSES)
                with np.errstate(invalid="ignore", over="ignore"):
                    logits = x @ weight[of].T + bias[of]
                    state.scores(logits, index[of])
                    if labelled:
                        state.label(logits, index[of], _floats(part, "label"))
                    if placed:
                        km = _km(_floats(part, "lat"), _floats(part, "lon"), _floats(theirs, "clat")[of], _floats(theirs, "clon")[of])
                        state.truth(logits, km, tau_km)
            scored = ~np.isnan(state.peak) & bool(len(index))
            for n in numbers:
                value = getattr(state, n)
                found[n].append(np.where(scored & ~np.isinf(value) | (n == "peak") & scored, value, np.nan))
            sizes = np.where(scored, state.top.shape[1], 0)
            at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            found["_logits"].append(pa.ListArray.from_arrays(at, pa.array(state.top[scored].ravel())))
            found["_classes"].append(pa.ListArray.from_arrays(at, pa.array(state.index[scored].ravel())))
        columns = {n: pa.array(np.concatenate(found[n]), from_pandas=True) for n in numbers}
        columns |= {n: pa.chunked_array(found[n]) for n in ("_logits", "_classes")}
        return columns | {"sample_id": mine.column("sample_id"), "_row": mine.column("_row")}

    per_row = 8 * (dim + 4)
    states, packs = _meetings(
        samples, weights, dim, max(1, CHUNK_BYTES // per_row), max(1, BLOCK_BYTES // per_row), match, T.StructType(fields)
    )
    states = states.withColumn("top", F.zip_with("_logits", "_classes", lambda x, c: F.struct(x.alias("logit"), c.alias("geocell_index"))))
    states = states.drop("_logits", "_classes")
    return (_merged(states, k, tau_km) if packs > 1 else states).drop("_row")


def _merged(states: DataFrame, k: int, tau_km: float) -> DataFrame:
    """One state for each row number from those of its packs, of which there are as many as packs."""
    names = [c for c in states.columns if c not in ("sample_id", "_row")]
    parts = states.groupBy("sample_id", "_row").agg(F.collect_list(F.struct(*names)).alias("b"))
    parts = parts.withColumns({"peak": F.array_max(F.transform("b", lambda s: s["peak"]))})
    parts = parts.withColumn("near", F.array_min(F.transform("b", lambda s: s["near"])))

    def added(value, scale) -> Column:
        kept = F.filter(F.transform("b", lambda s: value(s) * scale(s)), lambda v: v.isNotNull())
        return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v))

    def fade(s: Column) -> Column:
        return F.exp(-(s["near"] - F.col("near")) / tau_km)

    best_first = F.array_sort(
        F.flatten(F.transform("b", lambda s: s["top"])),
        lambda p, q: F.when(p["logit"] > q["logit"], -1)
        .when(p["logit"] < q["logit"], 1)
        .otherwise(F.when(p["geocell_index"] < q["geocell_index"], -1).otherwise(1)),
    )
    return parts.select(
        "sample_id",
        "_row",
        "peak",
        added(lambda s: s["total"], lambda s: F.exp(s["peak"] - F.col("peak"))).alias("total"),
        F.array_max(F.transform("b", lambda s: s["own"])).alias("own"),
        "near",
        added(lambda s: s["share"], fade).alias("share"),
        added(lambda s: s["shared"], fade).alias("shared"),
        F.slice(best_first, 1, k).alias("top"),
    )


def score_linear_head(samples: DataFrame, weights: DataFrame, cells: DataFrame, dim: int, k: int = 5) -> DataFrame:
    """Best class with its centroid, and the k most probable classes, of every sample.

    Without any class, or without a vector, a sample has no candidates; a best class without centroid has NULL
    coordinates.
    """
    probability = lambda t: F.exp(t["logit"] - F.col("peak")) / F.col("total")
    candidates = F.transform("top", lambda t: F.struct(t["geocell_index"].alias("geocell_index"), probability(t).alias("probability")))
    ready = class_states(samples.select("sample_id", "embedding"), weights, dim, k).select("sample_id", candidates.alias("candidates"))
    ready = ready.withColumn("geocell_index", F.get("candidates", F.lit(0))["geocell_index"])
    where = cells.select("geocell_index", F.col("clat").alias("pred_lat"), F.col("clon").alias("pred_lon"))
    return ready.join(where, "geocell_index", "left")


def candidate_rows(scored: DataFrame) -> DataFrame:
    """The candidates of ``score_linear_head`` as rows, ranked from 0."""
    listed = scored.select("sample_id", F.posexplode("candidates").alias("candidate", "c"))
    return listed.select("sample_id", "candidate", "c.geocell_index", "c.probability")


def soft_head_loss(
    samples: DataFrame, weights: DataFrame, cells: DataFrame, dim: int, tau_km: float = K.LABEL_SMOOTHING_KM
) -> DataFrame:
    """``measures.soft_label_loss`` straight from vectors (sample_id, embedding, lat, lon): (n, loss, n_missing)."""
    states = class_states(samples.select("sample_id", "embedding", "lat", "lon"), weights, dim, 0, cells, tau_km)
    loss = F.col("peak") + F.log("total") - F.col("shared") / F.greatest("share", F.lit(1e-12))
    return mean_loss(states.select(F.when(F.col("near").isNotNull(), loss).alias("loss")))


def hard_head_loss(samples: DataFrame, weights: DataFrame, dim: int) -> DataFrame:
    """``measures.hard_label_loss`` straight from vectors (sample_id, embedding, label): (n, loss, n_missing)."""
    states = class_states(samples.select("sample_id", "embedding", "label"), weights, dim)
    return mean_loss(states.select((F.col("peak") + F.log("total") - F.col("own")).alias("loss")))


def topk_candidates(probabilities: DataFrame, k: int = 5) -> DataFrame:
    """The k most probable cells of every sample, ties to the lower index, ranked from 0."""
    order = [F.col("probability").desc(), F.col("geocell_index")]
    kept = top_per_key(probabilities, ["sample_id"], order, k, rank="_at")
    return kept.withColumn("candidate", F.col("_at") - 1).drop("_at")


# ---- nearest vector inside a group -------------------------------------------


def _distinct_vectors(items: DataFrame, keys: Sequence[str], key: str, payload: Sequence[str]) -> DataFrame:
    """Copies of a vector inside a group are represented by the one with the smallest key."""
    first = F.min(F.struct(key, *payload)).alias("_i")
    return items.groupBy(*keys, "vector").agg(first).select(*keys, "vector", "_i.*")


def _best_in_block(queries: np.ndarray, vectors: np.ndarray, keys: np.ndarray, farthest: bool):
    """Row of the best vector for every query, and the distance, for one block of each.

    A matrix product rates all pairs up to rounding; the few that could still win
    are measured exactly, and equal distances go to the smaller key.
    """
    qq, vv = (queries**2).sum(axis=1), (vectors**2).sum(axis=1)
    rated = qq[:, None] + vv[None, :] - 2.0 * (queries @ vectors.T)
    slack = (1e-9 * (qq + vv.max()) + 1e-18)[:, None]
    if farthest:
        row, col = np.nonzero(rated >= rated.max(axis=1, keepdims=True) - slack)
    else:
        row, col = np.nonzero(rated <= rated.min(axis=1, keepdims=True) + slack)
    gap = np.round(np.sqrt(((queries[row] - vectors[col]) ** 2).sum(axis=1)), 9)
    order = np.lexsort((keys[col], -gap if farthest else gap, row))
    _, first = np.unique(row[order], return_index=True)
    chosen = order[first]
    return col[chosen], gap[chosen]


def closest_vector(
    queries: DataFrame,
    samples: DataFrame,
    items: DataFrame,
    query_keys: Sequence[str],
    group: Sequence[str],
    key: str,
    payload: Sequence[str],
    farthest: bool = False,
) -> DataFrame:
    """Add the closest (or farthest) item of its group in Euclidean distance to each query.

    ``queries`` names the groups, ``samples`` holds the query vectors (sample_id,
    embedding), ``items`` has ``vector``; ties go to the smaller ``key``, and a query
    whose group is empty gets NULLs.  The queries of a group are cut into chunks and
    its items into packs of bounded size.  A task meets one chunk and one pack at a
    time and returns one row per query, so a hot group is simply more such meetings.
    """
    query_keys, group = list(query_keys), list(group)
    queries = cut_lineage(queries)
    # A cogroup meets equal keys only if both sides hash them as one type: an int and a bigint go to different tasks.
    kinds = {f.name: f.dataType for f in queries.select(*group).union(items.select(*group)).schema}
    stock = _distinct_vectors(items.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()}), group, key, payload)
    chunks = queries.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / CHUNK_SIZE).alias("_chunks"))
    packs = stock.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / PACK_SIZE).alias("_packs"))
    shape = cut_lineage(chunks.join(packs, group))

    asked = queries.select(*query_keys, *[F.col(c).cast(kind) for c, kind in kinds.items()]).join(shape, group)
    asked = asked.join(samples.select("sample_id", "embedding"), "sample_id").select(
        *query_keys,
        *group,
        F.pmod(F.xxhash64(*query_keys), F.col("_chunks")).alias("_chunk"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_packs") - 1)).alias("_pack"),
        "embedding",
    )
    stock = stock.join(shape, group).select(
        *group,
        key,
        *payload,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)).alias("_chunk"),
        F.pmod(F.xxhash64(key), F.col("_packs")).alias("_pack"),
        "vector",
    )
    fields = [asked.schema[c] for c in query_keys] + [T.StructField("gap", T.DoubleType())]
    fields += [stock.schema[c] for c in (key, *payload)]
    names = [f.name for f in fields]

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({name: [] for name in names})
        at, gap = _best_in_block(
            np.stack(left["embedding"].to_numpy()).astype(np.float64),
            np.stack(right["vector"].to_numpy()).astype(np.float64),
            right[key].to_numpy(),
            farthest,
        )
        found = left[query_keys].assign(gap=gap)
        for name in (key, *payload):
            found[name] = right[name].to_numpy()[at]
        return found[names]

    blocks = [*group, "_chunk", "_pack"]
    hits = asked.groupBy(*blocks).cogroup(stock.groupBy(*blocks)).applyInPandas(match, T.StructType(fields))
    order = F.col("gap").desc() if farthest else F.col("gap").asc()
    return queries.join(top_per_key(hits, query_keys, [order, F.col(key)]), query_keys, "left")


def nearest_prototype(samples: DataFrame, candidates: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Closest prototype of every candidate cell; a cell without prototypes gets logit -100000 at (0, 0).

    ``candidates`` has sample_id, candidate, geocell_index and probability;
    ``prototypes`` has geocell_index, cluster_id, embedding, centroid_lat, centroid_lon.
    """
    placed = closest_vector(
        candidates,
        samples,
        prototypes.withColumnRenamed("embedding", "vector"),
        ["sample_id", "candidate"],
        ["geocell_index"],
        "cluster_id",
        ["centroid_lat", "centroid_lon"],
    )
    return placed.withColumns(
        {
            "logit": F.coalesce(-F.col("gap"), F.lit(K.MISSING_LOGIT)),
            "centroid_lat": F.coalesce("centroid_lat", F.lit(0.0)),
            "centroid_lon": F.coalesce("centroid_lon", F.lit(0.0)),
        }
    ).drop("gap")


def nearest_member(samples: DataFrame, clusters: DataFrame, members: DataFrame, pick: str = "nearest") -> DataFrame:
    """Position of the best matching image of the chosen cluster; an empty cluster keeps its centroid.

    ``clusters`` comes from :func:`nearest_prototype`; ``members`` has geocell_index,
    cluster_id, point_idx, embedding, lat, lon.  ``pick`` is nearest or farthest.
    """
    items = members.select(
        "geocell_index",
        "cluster_id",
        "point_idx",
        F.col("embedding").alias("vector"),
        F.col("lat").alias("m_lat"),
        F.col("lon").alias("m_lon"),
    )
    placed = closest_vector(
        clusters,
        samples,
        items,
        ["sample_id", "candidate"],
        ["geocell_index", "cluster_id"],
        "point_idx",
        ["m_lat", "m_lon"],
        pick == "farthest",
    )
    return placed.withColumns(
        {"lat": F.coalesce("m_lat", "centroid_lat"), "lon": F.coalesce("m_lon", "centroid_lon")}
    ).drop("m_lat", "m_lon", "gap")


def refine_prediction(
    samples: DataFrame,
    candidates: DataFrame,
    prototypes: DataFrame,
    members: DataFrame,
    topk: int = 5,
    max_km: float = K.REFINE_MAX_KM,
    temperature: float = K.REFINE_TEMPERATURE,
    pick: str = "nearest",
) -> DataFrame:
    """Refined cell and coordinates of every sample.

    Prototype logits are turned into weights by a tempered softmax and multiplied
    with the cell probabilities.  When the winner lies more than ``max_km`` from the
    initial prediction (``init_lat``, ``init_lon`` of ``samples``), the most probable
    cell is taken instead.  Without ``probability`` only candidate 0 counts.

    The list of candidates is carried through without vectors.
    """
    if "probability" not in candidates.columns:
        candidates = candidates.withColumn("probability", (F.col("candidate") == 0).cast("double"))
    asked = candidates.where(F.col("candidate") < topk)
    placed = nearest_member(samples, nearest_prototype(samples, asked, prototypes), members, pick)
    # At most topk rows per sample are gathered.
    row = F.struct("candidate", "geocell_index", "cluster_id", "probability", "logit", "lat", "lon")
    listed = placed.groupBy("sample_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    listed = listed.join(samples.select("sample_id", "init_lat", "init_lon"), "sample_id")
    listed = listed.withColumn(
        "c", F.when(F.size("c") < topk, F.raise_error(F.lit("fewer candidates than topk"))).otherwise(F.col("c"))
    )

    def field(name: str) -> Column:
        return F.transform("c", lambda s: s[name])

    def first_max(values: str) -> Column:
        return F.array_position(values, F.array_max(values)).cast("int")

    shifted = F.transform(field("logit"), lambda v: F.exp((v - F.array_max(field("logit"))) / temperature))
    listed = listed.withColumn("e", shifted)
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    listed = listed.withColumns(
        {"p": field("probability"), "f": F.zip_with(field("probability"), "e", lambda p, e: p * e / total)}
    )
    listed = listed.withColumns({"initial": first_max("p"), "refined": first_max("f")})
    win = F.element_at("c", F.col("refined"))
    km = haversine_km(F.col("init_lat"), F.col("init_lon"), win["lat"], win["lon"], K.LABEL_RADIUS_M)
    final = F.when(km > max_km, F.col("initial")).otherwise(F.col("refined"))
    listed = listed.withColumn("at", final).withColumn("w", F.element_at("c", F.col("at")))
    return listed.select(
        "sample_id",
        (F.col("at") - 1).alias("candidate"),
        F.col("w.geocell_index").alias("geocell_index"),
        F.col("w.lat").alias("lat"),
        F.col("w.lon").alias("lon"),
        F.element_at("f", F.col("at")).alias("weight"),
    )


# ---- evaluation --------------------------------------------------------------


def evaluate(predictions: DataFrame, truth: DataFrame, meta: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nested result per sample and the summary over all samples.

    ``predictions`` comes from :func:`score_linear_head`; ``meta`` names the cells
    (geocell_index, country, admin1).  A sample without truth, or whose best class has
    no centroid, keeps its row with NULL distance and score.
    """
    joined = predictions.join(truth.select("sample_id", "lat", "lon", "true_cell"), "sample_id", "left")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("pred_lat"), F.col("pred_lon"), K.SCORE_RADIUS_M)
    listed = joined.select("sample_id", F.posexplode("candidates").alias("at", "c"))
    named = listed.select("sample_id", "at", "c.geocell_index", "c.probability")
    named = named.join(meta.select("geocell_index", "country", "admin1"), "geocell_index", "left")
    entry = F.struct(
        "at",
        "geocell_index",
        "probability",
        F.coalesce("country", F.lit("?")).alias("country"),
        F.coalesce("admin1", F.lit("?")).alias("admin1"),
    )
    top = named.groupBy("sample_id").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    top = top.select(
        "sample_id",
        F.transform("t", lambda e: e.dropFields("at")).alias("top5_geocells"),
    )
    results = joined.join(top, "sample_id", "left").select(
        "sample_id",
        "true_cell",
        F.struct("lat", "lon").alias("ground_truth"),
        F.struct(F.col("pred_lat").alias("lat"), F.col("pred_lon").alias("lon")).alias("prediction"),
        km.alias("distance_km"),
        game_score(km).alias("score"),
        F.slice("top5_geocells", 1, k).alias("top5_geocells"),
    )
    flat = results.withColumn("top1_prob", F.get("top5_geocells", F.lit(0))["probability"])
    return results, result_summary(flat, check=False)
