"""Uniform points inside polygons, and the run that draws until enough of them are covered."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens.functions.scalar import hash_uniform, round6
from geolens.operators.clipped import clip, settle
from geolens.operators.measures import with_rate
from geolens.operators.spatial import polygon_table, snap_to_coverage
from geolens.operators.spread import global_index, rank_in_group
from geolens.operators.tables import allocate_by_area
from geolens.session import cut_lineage, range_tasks

# Draws for each wanted point before a part is filled slab by slab instead.
TRIES_PER_POINT = 256
CHUNK = 10_000


def _draws(parts: DataFrame, first: str, last: str) -> DataFrame:
    """One row per trial number first..last of each part.

    Trial numbers are first made in chunks and spread over the cluster, so that a
    part asking for most of the points does not draw them all in one task.
    """
    chunks = F.sequence(F.floor(F.col(first) / CHUNK), F.floor(F.col(last) / CHUNK))
    spread = parts.withColumn("_c", F.explode(chunks)).repartition(range_tasks(parts.sparkSession), "part_id", "_c")
    start = F.greatest(F.col(first), F.col("_c") * CHUNK)
    end = F.least(F.col(last), F.col("_c") * CHUNK + (CHUNK - 1))
    return spread.withColumn("trial", F.explode(F.sequence(start, end))).drop("_c")


def _trapezoids(edges: np.ndarray) -> np.ndarray:
    """(y0, y1, left and width at y0, left and width at y1) of the slabs between corners that lie inside the shape."""
    low = np.where((edges[:, 1] <= edges[:, 3])[:, None], edges, edges[:, [2, 3, 0, 1]])
    low = low[low[:, 1] < low[:, 3]]
    low = low[np.argsort(low[:, 1], kind="stable")]
    levels, out, active, at = np.unique(low[:, [1, 3]]), [], low[:0], 0
    for y0, y1 in zip(levels[:-1], levels[1:]):
        upto = int(np.searchsorted(low[:, 1], y0, side="right"))
        active = np.concatenate((active[active[:, 3] > y0], low[at:upto]))
        at = upto
        slope = (active[:, 2] - active[:, 0]) / (active[:, 3] - active[:, 1])
        x0, x1 = active[:, 0] + slope * (y0 - active[:, 1]), active[:, 0] + slope * (y1 - active[:, 1])
        order = np.argsort(x0 + x1, kind="stable")
        x0, x1 = x0[order], x1[order]
        for k in range(0, len(order) - 1, 2):
            out.append((y0, y1, x0[k], x0[k + 1] - x0[k], x1[k], x1[k + 1] - x1[k]))
    return np.array(out).reshape(-1, 6)


def _draw_in_slabs(edges: np.ndarray, n: int, seed: str) -> tuple[np.ndarray, np.ndarray]:
    t = _trapezoids(edges)
    area = (t[:, 1] - t[:, 0]) * (t[:, 3] + t[:, 5]) / 2 if len(t) else np.zeros(0)
    if not area.sum() > 0:
        raise ValueError("a polygon part without area was asked for points")
    rng = np.random.default_rng(int.from_bytes(hashlib.md5(seed.encode()).digest()[:8], "big"))
    t = t[rng.choice(len(t), n, p=area / area.sum())]
    u, v = rng.random(n), rng.random(n)
    a, b = t[:, 3], t[:, 5]
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(np.isclose(a, b, rtol=1e-12, atol=0), u, (np.sqrt(a * a + u * (b * b - a * a)) - a) / (b - a))
    return t[:, 2] + up * (t[:, 4] - t[:, 2]) + v * (a + up * (b - a)), t[:, 0] + up * (t[:, 1] - t[:, 0])


def _fill(short: DataFrame, seed: int) -> DataFrame:
    """The missing points of parts that fill little of their box: slabs by area, then a place inside the slab."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("take") - F.col("got") - 1) / CHUNK))
    rows = short.withColumn("_c", F.explode(chunks)).repartition(range_tasks(short.sparkSession), "part_id", "_c")
    n = F.least(F.lit(CHUNK), F.col("take") - F.col("got") - F.col("_c") * CHUNK)
    first = F.col("from_t") + F.col("_c") * CHUNK
    flat = F.flatten(F.transform("edges", lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))
    rows = rows.select("country", "part_id", F.concat_ws(":", F.lit(str(seed)), "part_id", "_c").alias("key"), n.alias("n"), first.alias("first"), flat.alias("edges"))
    kinds = {f.name: f.dataType.simpleString() for f in short.schema}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                lon, lat = _draw_in_slabs(np.asarray(r.edges, np.float64).reshape(-1, 4), int(r.n), r.key)
                yield pd.DataFrame({"country": [r.country] * int(r.n), "part_id": r.part_id, "trial": np.arange(r.first, r.first + r.n), "lat": lat, "lon": lon})

    return rows.mapInPandas(draw, f"country {kinds['country']}, part_id {kinds['part_id']}, trial long, lat double, lon double")


def sample_in_polygons(parts: DataFrame, need: int | str, scalar: float = 1.0, seed: int = 42) -> DataFrame:
    """Points drawn uniformly inside each polygon part, boundary excluded.

    ``parts`` has country, part_id, area, edges and box columns; the number per part
    comes from :func:`allocate_by_area`.  Trial ``t`` of a part is a fixed function of
    seed, part and ``t``, and a part keeps its first accepted trials, so neither the
    partitioning nor the number of rounds shows in the result.  Trials meet the squares of their part, which are cut
    once and hold local edges only.  Parts still short
    after a round draw on; those that fill too little of their box for that are cut
    into slabs and filled exactly.  Every part gets its number of points.
    """
    planned = cut_lineage(allocate_by_area(parts, need, scalar).where(F.col("take") > 0))
    box = ["min_x", "min_y", "max_x", "max_y"]
    columns = ["country", "part_id", "take", *box]
    squares, levels, size = clip(planned.select(F.col("part_id"), "edges", *box))
    open_parts = planned.select(*columns, F.lit(0).cast("bigint").alias("got"), F.lit(1).cast("bigint").alias("from_t"))
    kept, factor = None, 4
    while True:
        limit = F.col("take") * TRIES_PER_POINT
        aim = F.col("from_t") + (F.col("take") - F.col("got")) * factor - 1
        batch = open_parts.withColumn("to_t", F.least(aim, limit))
        key = F.concat_ws(":", F.col("part_id").cast("string"), F.col("trial").cast("string"))
        drawn = _draws(batch, "from_t", "to_t").select(
            "country",
            "part_id",
            "take",
            "got",
            "trial",
            (F.col("min_x") + hash_uniform(key, seed, "x") * (F.col("max_x") - F.col("min_x"))).alias("lon"),
            (F.col("min_y") + hash_uniform(key, seed, "y") * (F.col("max_y") - F.col("min_y"))).alias("lat"),
        )
        hits = settle(drawn, squares, levels, size, False, ["part_id"])
        ranked = rank_in_group(hits, ["part_id"], [F.col("trial")], "_at")
        fresh = ranked.where(F.col("_at") <= F.col("take") - F.col("got"))
        fresh = cut_lineage(fresh.select("country", "part_id", "trial", "lat", "lon"))
        kept = fresh if kept is None else kept.unionByName(fresh)
        added = fresh.groupBy("part_id").agg(F.count(F.lit(1)).alias("added"))
        grown = batch.join(added, "part_id", "left").withColumns(
            {"got": F.col("got") + F.coalesce("added", F.lit(0)), "from_t": F.col("to_t") + 1}
        )
        short = cut_lineage(grown.where(F.col("got") < F.col("take")).select(*columns, "got", "from_t"))
        open_parts = short.where(F.col("from_t") <= limit)
        slivers = short.where(F.col("from_t") > limit).join(planned.select("part_id", "edges"), "part_id")
        if not slivers.isEmpty():
            kept = kept.unionByName(cut_lineage(_fill(slivers, seed)))
        if open_parts.isEmpty():
            return kept
        factor *= 2


# ---- the whole run ----------------------------------------------------------


class SamplingRun(NamedTuple):
    points: DataFrame  # country, lat, lon, round: distinct covered positions
    candidates: DataFrame  # country, part_id, round, trial, lat, lon: what was drawn
    report: DataFrame  # country, asked, candidates, covered, rate, needed, rounds


def boundary_parts(boundaries: DataFrame) -> DataFrame:
    """Polygon parts as the sampler takes them, from :func:`geolens.sources.text.read_boundaries`.

    Parts get one number over all countries, in the order of their names and places in the file.  A part that is
    listed twice counts once; parts without a ring or an area are left out.
    """
    names = ["country", "name_1", "name_2", "part_id"]
    shape = F.md5(F.to_json("rings"))
    solid = boundaries.where((F.col("area") > 0) & (F.size("rings") > 0)).withColumn("_shape", shape)
    once = solid.dropDuplicates([*names, "_shape"])
    numbered = global_index(once, [F.col(c) for c in (*names, "_shape")], "_part")
    return polygon_table(numbered.select("country", F.col("_part").alias("part_id"), "area", "rings"))


def sampling_run(
    parts: DataFrame,
    coverage: DataFrame,
    target: int,
    radius_m: float = 60.0,
    scalar: float = 1.0,
    seed: int = 42,
    limit: int | None = None,
    max_rounds: int = 16,
) -> SamplingRun:
    """Draw candidates in every country until ``target`` distinct positions of it are covered.

    The first round asks for ``target`` candidates of each country, dealt to its parts by area.  Candidates snap to
    the nearest covered position (lat, lon of ``coverage``) within ``radius_m``.  A country still short asks for as
    many more as its rate so far suggests, but at least half of what it has asked for, or as many again if nothing
    was covered, so the rounds grow geometrically; it gives up at ``limit`` candidates (100 for each wanted point) or
    after ``max_rounds``.  Round k draws with seed ``seed + k``, so its trials are new ones.

    A position covered from two countries counts in both.  Parts without a country are one country.  The last
    round's surplus stays.  A country whose parts have no area is not reported; empty tables give empty results.
    """
    limit = 100 * target if limit is None else limit
    parts, sites = cut_lineage(parts), cut_lineage(coverage.select("lat", "lon").dropna().distinct())
    zero = F.lit(0).cast("bigint")
    state = parts.groupBy("country").agg(F.sum("area").alias("_area")).where(F.col("_area") > 0)
    state = cut_lineage(state.select("country", zero.alias("asked"), zero.alias("candidates"), zero.alias("covered"), zero.alias("rounds")))
    points = candidates = None
    for k in range(max_rounds):
        by_rate = F.ceil(F.try_divide((F.lit(target) - F.col("covered")) * F.col("candidates"), F.col("covered")))
        more = F.when(F.col("asked") == 0, F.lit(target)).when(F.col("covered") == 0, F.col("asked"))
        more = more.otherwise(F.greatest(by_rate, F.ceil(F.col("asked") / 2))).cast("bigint")
        open_ = (F.col("covered") < target) & (F.col("asked") < limit)
        wanted = state.where(open_).select("country", F.least(more, limit - F.col("asked")).alias("_more"))
        if k and wanted.isEmpty():
            break
        asked = parts.join(wanted.withColumnRenamed("country", "_land"), F.col("country").eqNullSafe(F.col("_land"))).drop("_land")
        drawn = cut_lineage(sample_in_polygons(asked, "_more", scalar, seed + k).withColumn("round", F.lit(k)))
        snapped = snap_to_coverage(drawn, sites, radius_m)
        place = drawn.join(snapped, ["lat", "lon"]).select("country", round6(F.col("s_lat")).alias("lat"), round6(F.col("s_lon")).alias("lon")).distinct()
        if points is not None:
            old = points.select(F.col("country").alias("_land"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
            same = F.col("country").eqNullSafe(F.col("_land")) & (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))
            place = place.join(old, same, "left_anti")
        fresh = cut_lineage(place.withColumn("round", F.lit(k)))
        points = fresh if points is None else points.unionByName(fresh)
        candidates = drawn if candidates is None else candidates.unionByName(drawn)
        news = wanted.withColumnRenamed("_more", "asked").withColumns({"candidates": zero, "covered": zero, "rounds": F.lit(1).cast("bigint")})
        for name, rows in (("candidates", drawn), ("covered", fresh)):
            counts = rows.groupBy("country").agg(F.count(F.lit(1)).alias(name))
            news = news.unionByName(counts.select("country", *[F.col(c) if c == name else zero.alias(c) for c in state.columns[1:]]))
        both = state.unionByName(news)
        state = cut_lineage(both.groupBy("country").agg(*[F.sum(c).alias(c) for c in state.columns[1:]]))
    return SamplingRun(points, candidates.select("country", "part_id", "round", "trial", "lat", "lon"), with_rate(state, target))
