"""Building geocells: partitioning, merging, clustering, splitting, prototypes.

The loops below exchange whole tables, cut their lineage every round through the
shared folder and only bring counters to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolens import constants as K
from geolens.operators.grid import distance, square, with_box_keys, with_point_key
from geolens.operators.measures import exact_median
from geolens.operators.spread import rank_in_group, salted_join, top_per_key
from geolens.operators.tables import geocell_index
from geolens.session import cut_lineage

# ---- C1: recursive halving ---------------------------------------------------


def rect_partition(points: DataFrame, max_points: int) -> DataFrame:
    """Halve every cell with more than ``max_points`` points until none is left.

    A cell is cut at the middle of the longer side of its tight box; points beyond
    the middle go to child ``1``, the others to child ``0``, and ties of the sides
    cut the latitude.  A cell whose points all coincide is kept as it is.  Points
    without finite coordinates belong to no cell.  Points are reduced to weighted
    distinct positions, and finished cells leave the loop.  Returns one row per leaf.
    """
    for name in ("lat", "lon"):
        points = points.where(F.abs(F.col(name).cast("double")) < F.lit(float("inf")))
    spots = points.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.lit(""))
    open_spots, leaves = cut_lineage(spots), None
    while True:
        boxes = open_spots.groupBy("cell").agg(
            F.sum("n").alias("n_points"),
            F.min("lat").alias("min_lat"),
            F.max("lat").alias("max_lat"),
            F.min("lon").alias("min_lon"),
            F.max("lon").alias("max_lon"),
        )
        spread = (F.col("max_lat") > F.col("min_lat")) | (F.col("max_lon") > F.col("min_lon"))
        boxes = cut_lineage(boxes.withColumn("split", (F.col("n_points") > max_points) & spread))
        done = boxes.where(~F.col("split")).drop("split")
        leaves = done if leaves is None else leaves.unionByName(done)
        if boxes.where("split").isEmpty():
            return leaves
        by_lon = (F.col("max_lon") - F.col("min_lon")) > (F.col("max_lat") - F.col("min_lat"))

        def middle(low: Column, high: Column) -> Column:
            """Between neighbouring numbers the middle may round up to the larger one; then the smaller one cuts."""
            half = (high + low) / 2
            return F.when(half >= high, low).otherwise(half)

        upper = F.when(by_lon, F.col("lon") > middle(F.col("min_lon"), F.col("max_lon"))).otherwise(
            F.col("lat") > middle(F.col("min_lat"), F.col("max_lat"))
        )
        child = F.concat("cell", F.when(upper, "1").otherwise("0"))
        cut = salted_join(open_spots, boxes.where("split").drop("split", "n_points"), ["cell"])
        open_spots = cut_lineage(cut.withColumn("cell", child).select("lat", "lon", "n", "cell"))


# ---- C2: merging sparse cells ------------------------------------------------


def merge_sparse_cells(
    cells: DataFrame, neighbours: DataFrame, min_points: int = K.MIN_CELL_POINTS, seed: int = 42
) -> DataFrame:
    """Let cells below ``min_points`` absorb neighbours until they reach it; returns (cell_id, root).

    Every round each sparse cell that still has neighbours asks for the one with
    the smallest id, whatever its size.  Where requests overlap, the one with the
    smaller hash of (round, cell) wins both cells; the others try again.  The
    absorbed cell's points and edges pass to the winner.  A component that runs
    out of neighbours stays below the threshold.
    """
    state = cut_lineage(cells.select(F.col("cell_id").alias("region"), F.col("n_points").cast("bigint").alias("n")))
    edges = cut_lineage(neighbours.select("src", "dst").distinct())
    roots = state.select(F.col("region").alias("cell_id"), F.col("region").alias("root"))
    turn = 0
    while True:
        sparse = state.where(F.col("n") < min_points).select("region")
        wishes = (
            edges.join(sparse, edges.src == sparse.region)
            .groupBy("region")
            .agg(F.min("dst").alias("target"))
            .withColumn("priority", F.md5(F.concat(F.lit(f"{seed}:{turn}:"), F.col("region").cast("string"))))
        )
        claim = F.struct("priority", "region")
        claims = wishes.select(F.explode(F.array("region", "target")).alias("claimed"), claim.alias("claim"))
        held = claims.groupBy("claimed").agg(F.min("claim.priority").alias("best"))
        moves = (
            wishes.join(held.select(F.col("claimed").alias("region"), F.col("best").alias("own")), "region")
            .join(held.select(F.col("claimed").alias("target"), F.col("best").alias("other")), "target")
            .where((F.col("own") == F.col("priority")) & (F.col("other") == F.col("priority")))
            .select(F.col("target").alias("old"), F.col("region").alias("new"))
        )
        moves = cut_lineage(moves)
        if moves.isEmpty():
            return roots

        def moved(df: DataFrame, column: str) -> DataFrame:
            joined = df.join(moves, df[column] == moves.old, "left")
            return joined.withColumn(column, F.coalesce("new", column)).drop("old", "new")

        state = cut_lineage(moved(state, "region").groupBy("region").agg(F.sum("n").alias("n")))
        edges = moved(moved(edges, "src"), "dst").where(F.col("src") != F.col("dst")).distinct()
        edges = cut_lineage(edges)
        roots = cut_lineage(moved(roots, "root"))
        turn += 1


# ---- C4: core distance -------------------------------------------------------

LISTED = 512  # positions of a square that a task compares with its tile's
CORE_TILE = 4  # squares a side of such a tile
SMALLEST = 1e-7  # of the squares, in degrees; below, rounding moves positions between squares


def _sized(spots: DataFrame, k: int) -> DataFrame:
    """Spots with the size ``s`` of the first squares of their cell and the cell's extent ``side``.

    Squares follow the density of their cell: were its positions spread evenly over their box, or along a line, a
    circle of radius ``s`` would hold 2.4 ``k`` of them.  Where a square holds over 16 ``k`` positions, all squares of
    the cell are divided by four, as often as needed.
    """
    height, width = F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")
    cells = spots.groupBy("cell_id").agg(
        F.sum("n").alias("cell_n"),
        F.count(F.lit(1)).cast("double").alias("spots_n"),
        (height * width).alias("area"),
        F.greatest(height, width).alias("side"),
    )
    even = F.sqrt(F.col("area") * F.lit(2.4 * k / math.pi) / F.col("spots_n"))
    lined = F.col("side") * F.lit(1.2 * k) / F.col("spots_n")
    cells = cells.where(F.col("cell_n") >= k).select(
        "cell_id", "side", F.greatest(even, lined, F.lit(SMALLEST)).alias("s")
    )
    cells = cut_lineage(cells)
    sized = salted_join(spots, cells, ["cell_id"], spread_by=["lat", "lon"])
    for _ in range(20):
        squares = with_point_key(sized, [F.col("lat"), F.col("lon")], F.col("s")).groupBy("cell_id", "s", "g0", "g1")
        fullest = squares.agg(F.count(F.lit(1)).alias("_n")).groupBy("cell_id", "s").agg(F.max("_n").alias("_n"))
        crowded = cut_lineage(fullest.where((F.col("_n") > 16 * k) & (F.col("s") > SMALLEST)).select("cell_id", "_n"))
        if crowded.isEmpty():
            break
        smaller = F.when(F.col("_n").isNotNull(), F.greatest(F.col("s") / 4.0, F.lit(SMALLEST))).otherwise(F.col("s"))
        cells = cut_lineage(cells.join(crowded, "cell_id", "left").withColumn("s", smaller).drop("_n"))
        sized = salted_join(spots, cells, ["cell_id"], spread_by=["lat", "lon"])
    return cut_lineage(sized)


def _with_sides(squares: DataFrame) -> DataFrame:
    """Squares (g0, g1) and the eight around each."""
    for axis in ("g0", "g1"):
        squares = squares.withColumn(axis, F.explode(F.sequence(F.col(axis) - 1, F.col(axis) + 1)))
    return squares


def _settled_by_tiles(spots: DataFrame, seekers: DataFrame | None, k: int, name: str) -> DataFrame:
    """(cell_id, lat, lon, s, side, core distance) of seekers with ``k`` points in the squares around their square.

    Positions move to their tile of ``CORE_TILE`` x ``CORE_TILE`` squares and, near its border, to the tiles beside it;
    a task compares the positions of one tile at a time, so pairs are neither shuffled nor sorted by Spark.  For
    squares of bounded numbers of positions.  Without ``seekers``, all spots below ``k`` points seek.
    """
    at, tile = ["cell_id", "lat", "lon"], ["cell_id", "t0", "t1"]
    if seekers is None:
        rows = spots.withColumn("seeks", F.col("n") < k)
    else:
        rows = spots.join(seekers.select(*at, F.lit(True).alias("seeks")), at, "left").fillna(False, ["seeks"])
    rows = with_point_key(rows, [F.col("lat"), F.col("lon")], F.col("s"))
    for i in (0, 1):
        low, own, high = (F.floor((F.col(f"g{i}") + step) / CORE_TILE) for step in (-1, 0, 1))
        rows = rows.withColumn(f"t{i}", F.explode(F.sequence(low, high)))
        rows = rows.withColumn("seeks", F.col("seeks") & (F.col(f"t{i}") == own))
    placed = rows.repartition(*tile).sortWithinPartitions(*tile)
    wide = [F.col(c).cast("double").alias(f"w_{c}") for c in ("lat", "lon")]
    placed = placed.select(*tile, "lat", "lon", *wide, "n", "s", "side", "seeks")
    schema = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in (*at, "s", "side"))
    return placed.mapInArrow(_kth_gaps(k), f"{schema}, gap double").withColumnRenamed("gap", name)


def _kth_gaps(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task on rows in order of tiles: smallest distances within which a tile's positions count ``k`` or more."""

    def kth(y: np.ndarray, x: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        dy, dx = y[at][:, None] - y[None, :], x[at][:, None] - x[None, :]
        gap = np.sqrt(dx * dx + dy * dy)
        # k positions always hold at least k points, so the k nearest positions suffice.
        if len(n) > k:
            nearest = np.argpartition(gap, k - 1, axis=1)[:, :k]
            gap, n = np.take_along_axis(gap, nearest, 1), n[nearest]
        else:
            n = np.broadcast_to(n, gap.shape)
        order = np.argsort(gap, axis=1)
        upto = np.cumsum(np.take_along_axis(n, order, 1), axis=1)
        last = np.take_along_axis(order, (upto >= k).argmax(axis=1)[:, None], 1)
        return np.where(upto[:, -1] >= k, np.take_along_axis(gap, last, 1)[:, 0], np.nan)

    def settle(rows: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        y, x, n = (rows.column(c).to_numpy() for c in ("w_lat", "w_lon", "n"))
        seeks = rows.column("seeks").to_numpy(zero_copy_only=False)
        gaps = np.full(len(n), np.nan)
        for begin, end in zip(bounds, bounds[1:]):
            seekers = np.flatnonzero(seeks[begin:end])
            step = max(1, 100_000 // (end - begin))
            for i in range(0, len(seekers), step):
                at = seekers[i : i + step]
                gaps[begin + at] = kth(y[begin:end], x[begin:end], at, n[begin:end])
        out = [rows.column(c) for c in ("cell_id", "lat", "lon", "s", "side")]
        out = pa.RecordBatch.from_arrays([*out, pa.array(gaps)], ["cell_id", "lat", "lon", "s", "side", "gap"])
        return out.filter(pa.array(~np.isnan(gaps)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            new = np.zeros(rows.num_rows - 1, bool)
            for c in ("cell_id", "t0", "t1"):
                column = rows.column(c)
                new |= pc.not_equal(column.slice(1), column.slice(0, len(new))).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(new) + 1).tolist()]
            held = rows.slice(bounds[-1])
            if len(bounds) > 1:
                yield settle(rows.slice(0, bounds[-1]), bounds)
        if held is not None:
            yield settle(held, [0, held.num_rows])

    return run


def _settled_by_pairs(spots: DataFrame, seekers: DataFrame, k: int, name: str) -> DataFrame:
    """The same with a row for each pair, for squares of any number of positions."""
    axes = [F.col("b_lat"), F.col("b_lon")]
    hosts = spots.select("cell_id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "n", "s")
    hosts = with_point_key(hosts, axes, F.col("s")).drop("s")
    lows, highs = ([F.col(c) + step for c in ("lat", "lon")] for step in (-F.col("s"), F.col("s")))
    seekers = with_box_keys(seekers, lows, highs, F.col("s"))
    gap = distance([F.col("lat"), F.col("lon")], axes)
    pairs = salted_join(hosts, seekers, ["cell_id", "g0", "g1"], spread_by=["b_lat", "b_lon"])
    near = top_per_key(
        pairs.withColumn("gap", gap),
        ["cell_id", "lat", "lon"],
        [F.col("gap"), F.col("b_lat"), F.col("b_lon")],
        k,
        rank="at",
    )
    w = Window.partitionBy("cell_id", "lat", "lon").orderBy("at")
    reached = near.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") >= k)
    return reached.groupBy("cell_id", "lat", "lon", "s", "side").agg(F.min("gap").alias(name))


def _core_of_spots(spots: DataFrame, k: int, name: str) -> DataFrame:
    """(cell_id, lat, lon, core distance) of positions with weights ``n``, where there is a distance."""
    home = ["cell_id", "g0", "g1"]
    at = ["cell_id", "lat", "lon"]
    axes = [F.col("lat"), F.col("lon")]
    located = [F.abs(F.col(c).cast("double")) < F.lit(float("inf")) for c in ("lat", "lon")]
    placed = spots.where(located[0] & located[1]).select(*at, "n")
    found = placed.where(F.col("n") >= k).select(*at, F.lit(0.0).alias(name))
    spots = _sized(placed, k)
    open_spots = spots.where(F.col("n") < k).drop("n")
    first = True
    while not open_spots.isEmpty():
        hosts = spots
        if not first:  # few are left, which look at few squares
            sights = _with_sides(with_point_key(open_spots, axes, F.col("s")).select(*home).distinct()).distinct()
            hosts = cut_lineage(with_point_key(spots, axes, F.col("s")).join(sights, home, "left_semi").drop("g0", "g1"))
        squares = with_point_key(hosts, axes, F.col("s")).groupBy(*home)
        crowded = squares.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(LISTED, 16 * k)).drop("_n")
        crowded = cut_lineage(crowded)
        if crowded.isEmpty():
            reached = _settled_by_tiles(hosts, None if first else open_spots, k, name)
        else:
            crowded = _with_sides(crowded).distinct()
            keyed = with_point_key(open_spots, axes, F.col("s"))
            beside = cut_lineage(keyed.join(crowded, home, "left_semi").drop("g0", "g1"))
            quiet = cut_lineage(keyed.join(crowded, home, "left_anti"))
            sights = _with_sides(quiet.select(*home).distinct()).distinct()
            near = with_point_key(hosts, axes, F.col("s")).join(sights, home, "left_semi")
            reached = _settled_by_tiles(near.drop("g0", "g1"), quiet, k, name)
            reached = reached.unionByName(_settled_by_pairs(hosts, beside, k, name))
        # The squares' borders are rounded; a distance that close to the size is left to the next round.
        final = (F.col(name) <= F.col("s") * (1.0 - 1e-6)) | (F.col("s") >= F.col("side"))
        reached = cut_lineage(reached.where(final).select(*at, name))
        found = found.unionByName(reached)
        open_spots = open_spots.join(reached.drop(name), at, "left_anti")
        open_spots = cut_lineage(open_spots.withColumn("s", F.col("s") * 4.0))
        spots = spots.withColumn("s", F.col("s") * 4.0)
        first = False
    return found


def core_distance(points: DataFrame, k: int = K.CLUSTER_MIN_POINTS, name: str = "core_km_deg") -> DataFrame:
    """Distance in degrees to the k-th nearest point of the same cell, the point itself included.

    Equal positions count with their weight.  The search looks at the 3x3 squares
    around a position; when the k-th neighbour is no farther than the border of
    that block it is final, otherwise the position goes on to squares four times
    as large.  The first squares follow the density of the cell, so that most positions are settled at once, and
    are small enough for its most crowded spot, so
    crowds are settled before squares grow; only positions that look at a square of more than
    ``LISTED`` positions in a later round are joined pair by pair.  Cells with fewer than ``k`` points,
    and points without finite coordinates, have no core distance (NULL).
    """
    spots = cut_lineage(points.groupBy("cell_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n")))
    found = _core_of_spots(spots, k, name)
    return salted_join(points, found, ["cell_id", "lat", "lon"], "left")


# ---- connected components ----------------------------------------------------


CHUNK = 500_000  # edges that one task contracts at once


def _contraction(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task that replaces its edges, ``chunk`` by chunk, by edges from each node to the smallest it reaches."""

    def smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        root = np.arange(n)
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return root
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up

    def star(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = pa.Table.from_batches(held)
        src, dst = (pa.concat_arrays(edges.column(c).chunks) for c in ("src", "dst"))
        nodes = pc.unique(pa.concat_arrays([src, dst]))
        nodes = nodes.take(pc.sort_indices(nodes))
        a, b = (pc.index_in(side, nodes).to_numpy(zero_copy_only=False) for side in (src, dst))
        root = smallest_reached(a, b, len(nodes))
        far = np.flatnonzero(root != np.arange(len(nodes)))
        out = [nodes.take(pa.array(far)), nodes.take(pa.array(root[far]))]
        yield from pa.Table.from_arrays(out, ["src", "dst"]).to_batches(max_chunksize=10_000)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield from star(held)
                held, rows = [], 0
        if rows:
            yield from star(held)

    return contract


def near_components(edges: DataFrame, near: Sequence[str]) -> DataFrame:
    """:func:`connected_components` of edges (src, dst) that mostly stay in one place, given by columns ``near``.

    Tasks contract the edges of their places to stars, whatever links them outside; nodes that appear in one star
    only, at its rim, wait for their hub's root.  So only nodes on the borders of places go through the rounds.
    """
    there = edges.where(F.col("src") != F.col("dst")).repartition(*near).sortWithinPartitions(*near).select("src", "dst")
    stars = cut_lineage(there.mapInArrow(_contraction(CHUNK), there.schema))
    uses = stars.select(F.explode(F.array("src", "dst")).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    busy = cut_lineage(uses.where(F.col("_n") > 1).select("src"))
    links = cut_lineage(stars.join(busy, "src", "left_semi"))
    rims = stars.join(busy, "src", "left_anti")
    roots = cut_lineage(connected_components(links))
    rims = rims.join(roots, rims.dst == roots.node, "left").select("src", "dst", F.coalesce("root", "dst").alias("root"))
    rims = cut_lineage(rims)
    hubs = rims.select(F.col("dst").alias("node"), "root").distinct().join(roots, "node", "left_anti")
    return roots.unionByName(hubs).unionByName(rims.select(F.col("src").alias("node"), "root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (src, dst); the root is the smallest node.

    Alternates the large-star and small-star steps, which shortens long chains
    geometrically, until the edges are stars around the roots.
    """
    stars = cut_lineage(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low"))
        low = low.select("src", F.least("src", "low").alias("low"))
        large = salted_join(both, low, ["src"], spread_by=["dst"]).where(F.col("dst") > F.col("src"))
        large = large.select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        down = cut_lineage(down.where(F.col("src") != F.col("dst")))
        low = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = salted_join(down, low, ["src"], spread_by=["dst"])
        small = small.select(F.col("dst").alias("a"), "low").where(F.col("a") != F.col("low"))
        small = small.select(F.col("a").alias("src"), F.col("low").alias("dst"))
        stars = cut_lineage(small.unionByName(low.select("src", F.col("low").alias("dst"))).distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    members = stars.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())


# ---- C3: density clusters ----------------------------------------------------

TILE = 4  # squares a side, where pairs meet
PLACE = 64  # squares a side, where links are contracted


def _dense_links(inside: DataFrame) -> DataFrame:
    """Pairs of crowded squares holding two positions within eps of each other; ``inside`` has their positions.

    A pair of boxes is decided when their farthest corners are within reach, when
    two representatives are, or when the boxes are too far apart; undecided boxes
    are quartered and only they go on.  Work therefore follows the borders where
    distances are close to eps, not the number of position pairs.
    """

    def boxes(source: DataFrame, level: int) -> DataFrame:
        part = F.col("s") / (2.0**level)
        split = source.withColumns({"h0": square(F.col("lat"), part), "h1": square(F.col("lon"), part)})
        return split.groupBy("node", "cell_id", "g0", "g1", "eps", "h0", "h1").agg(
            F.min("lat").alias("y0"),
            F.max("lat").alias("y1"),
            F.min("lon").alias("x0"),
            F.max("lon").alias("x1"),
            F.min(F.struct("lat", "lon")).alias("rep"),
        )

    def verdict(pairs: DataFrame) -> DataFrame:
        def sure(axis: str) -> Column:
            return F.greatest(F.col(f"a_{axis}1") - F.col(f"b_{axis}0"), F.col(f"b_{axis}1") - F.col(f"a_{axis}0"))

        def apart(axis: str) -> Column:
            gap = F.greatest(F.col(f"a_{axis}0") - F.col(f"b_{axis}1"), F.col(f"b_{axis}0") - F.col(f"a_{axis}1"))
            return F.greatest(F.lit(0.0), gap)

        zero = F.lit(0.0)
        farthest = distance([sure("x"), sure("y")], [zero, zero])
        closest = distance([apart("x"), apart("y")], [zero, zero])
        reps = distance(
            [F.col("a_rep.lat"), F.col("a_rep.lon")], [F.col("b_rep.lat"), F.col("b_rep.lon")]
        )
        joined = (farthest <= F.col("eps")) | (reps <= F.col("eps"))
        return pairs.withColumn("joined", joined).where(joined | (closest <= F.col("eps")))

    def side(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
        own = [F.col(c).alias(f"{name}_{c}") for c in ("node", "y0", "y1", "x0", "x1", "rep", "h0", "h1")]
        return df.select(*keep, *own)

    level = 0
    current = boxes(inside, level)
    offsets = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
            for i in range(-2, 3)
            for j in range(-2, 3)
            if (i, j) > (0, 0)
        ]
    )
    reach = side(current, "a", ["cell_id", "g0", "g1", "eps"]).withColumn("o", F.explode(offsets))
    reach = reach.withColumns({"g0": F.col("g0") + F.col("o.i"), "g1": F.col("g1") + F.col("o.j")}).drop("o")
    pairs = reach.join(side(current, "b", ["cell_id", "g0", "g1"]), ["cell_id", "g0", "g1"])
    links = None
    while True:
        judged = cut_lineage(verdict(pairs.drop("cell_id", "g0", "g1")))
        yes = judged.where("joined").select(F.col("a_node").alias("src"), F.col("b_node").alias("dst")).distinct()
        links = yes if links is None else links.unionByName(yes)
        settled = yes.select(F.col("src").alias("a_node"), F.col("dst").alias("b_node"))
        undecided = judged.join(settled, ["a_node", "b_node"], "left_anti")
        undecided = cut_lineage(undecided.select("a_node", "b_node", "a_h0", "a_h1", "b_h0", "b_h1"))
        if undecided.isEmpty():
            return links
        level += 1
        nodes = undecided.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct()
        finer = cut_lineage(boxes(inside.join(nodes, "node", "left_semi"), level))
        up = {f"p{i}": F.shiftright(f"h{i}", 1) for i in (0, 1)}
        parents = finer.withColumns(up)
        a = side(parents, "a", ["eps", F.col("p0").alias("a_p0"), F.col("p1").alias("a_p1")])
        b = side(parents, "b", [F.col("p0").alias("b_p0"), F.col("p1").alias("b_p1")])
        olds = undecided.withColumnsRenamed({"a_h0": "a_p0", "a_h1": "a_p1", "b_h0": "b_p0", "b_h1": "b_p1"})
        pairs = olds.join(a, ["a_node", "a_p0", "a_p1"]).join(b, ["b_node", "b_p0", "b_p1"])


def density_clusters(
    points: DataFrame, eps: float | None = None, min_points: int = K.CLUSTER_MIN_POINTS, name: str = "cluster_id"
) -> DataFrame:
    """Density clusters of the points of each cell, in planar degrees; -1 is noise.

    A point with ``min_points`` points (itself included) within ``eps`` is a core
    point; core points within ``eps`` share a cluster, other points join the
    lowest cluster that has a core point within ``eps``.  Clusters are numbered per
    cell by their smallest core point id.  Without ``eps`` each cell uses the median
    of its core distances.

    Positions are put on squares whose diagonal is ``eps``.  A square with enough
    points is one cluster at once, so position pairs are only formed around
    sparsely filled squares, which hold fewer than ``min_points`` positions.  Pairs meet in tiles of
    ``TILE`` x ``TILE`` squares, to which the positions within reach of their borders go too, and links are first
    contracted inside places of ``PLACE`` x ``PLACE`` squares.
    """
    at = ["cell_id", "lat", "lon"]
    spots = points.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("pid"))
    if eps is None:
        spots = cut_lineage(spots)
        core = salted_join(spots, _core_of_spots(spots, min_points, "_core"), at).select("cell_id", "_core", "n")
        reach = exact_median(core, ["cell_id"], "_core", "eps", weight="n")
    else:
        reach = points.select("cell_id").distinct().withColumn("eps", F.lit(float(eps)))
    home = ["cell_id", "g0", "g1"]
    spots = spots.join(reach, "cell_id")
    spots = spots.withColumn("eps", F.greatest("eps", F.lit(1e-9)))
    spots = spots.withColumn("s", F.col("eps") * (0.5**0.5 * (1.0 - 1e-9)))
    spots = spots.withColumns({"g0": square(F.col("lat"), F.col("s")), "g1": square(F.col("lon"), F.col("s"))})
    spots = cut_lineage(spots)

    squares = spots.groupBy(*home).agg(F.sum("n").alias("square_n"), F.min("pid").alias("node"))
    squares = cut_lineage(squares)
    dense = squares.where(F.col("square_n") >= min_points)
    marked = cut_lineage(salted_join(spots, squares, home, spread_by=["lat", "lon"]))
    is_dense = F.col("square_n") >= min_points

    def part(size: int) -> dict[str, Column]:
        return {"t0": F.floor(F.col("g0") / size), "t1": F.floor(F.col("g1") / size)}

    # Sparse positions against everything within eps of them; eps is less than two squares.
    tile = ["cell_id", "t0", "t1"]
    loose = marked.where(~is_dense).withColumns(part(TILE))
    loose = loose.select(*tile, "g0", "g1", F.col("lat").alias("y"), F.col("lon").alias("x"), "eps", F.col("pid").alias("a"))
    around = marked.select(*home, "lat", "lon", "n", F.col("pid").alias("b"), "node", is_dense.alias("dense"))
    for i in (0, 1):
        low, high = (F.floor((F.col(f"g{i}") + step) / TILE) for step in (-2, 2))
        around = around.withColumn(f"t{i}", F.explode(F.sequence(low, high)))
    near = salted_join(around.drop("g0", "g1"), loose, tile, spread_by=["lat", "lon"])
    near = near.where(distance([F.col("y"), F.col("x")], [F.col("lat"), F.col("lon")]) <= F.col("eps"))
    near = cut_lineage(near.withColumns(part(PLACE)).select(*tile, "a", "b", "n", "node", "dense"))
    loose_core = near.groupBy("a").agg(F.sum("n").alias("reached")).where(F.col("reached") >= min_points).select("a")
    loose_core = cut_lineage(loose_core)

    # Nodes: crowded squares and loose core positions, named by their smallest core point.
    core_b = near.where(~F.col("dense")).join(loose_core.select(F.col("a").alias("b")), "b", "left_semi")
    to_core = near.where("dense").select(*tile, "a", F.col("node").alias("core")).distinct()
    to_core = cut_lineage(to_core.unionByName(core_b.select(*tile, "a", F.col("b").alias("core"))))
    edges = to_core.join(loose_core, "a", "left_semi").select(F.col("a").alias("src"), F.col("core").alias("dst"), *tile)
    places = dense.withColumns(part(PLACE)).select(F.col("node").alias("src"), *tile)
    edges = edges.unionByName(_dense_links(marked.where(is_dense)).join(places, "src"))
    roots = cut_lineage(near_components(edges, tile))
    nodes = dense.select("node").unionByName(loose_core.select(F.col("a").alias("node")))
    nodes = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))

    border = to_core.join(loose_core, "a", "left_anti").select("a", F.col("core").alias("node"))
    border = border.join(nodes, "node").groupBy("a").agg(F.min("root").alias("root"))
    loose_roots = border.unionByName(
        loose_core.withColumnRenamed("a", "node").join(nodes, "node").select(F.col("node").alias("a"), "root")
    )
    placed = marked.where(is_dense).join(nodes, "node").select("cell_id", "lat", "lon", "root")
    placed = placed.unionByName(
        marked.where(~is_dense)
        .join(loose_roots.withColumnRenamed("a", "pid"), "pid", "left")
        .select("cell_id", "lat", "lon", "root")
    )
    placed = cut_lineage(placed)
    numbers = rank_in_group(
        placed.where(F.col("root").isNotNull()).select("cell_id", "root").distinct(), ["cell_id"], [F.col("root")], "_no"
    )
    numbers = numbers.select("cell_id", "root", (F.col("_no") - 1).alias(name))
    labels = placed.join(numbers, ["cell_id", "root"], "left").drop("root")
    out = salted_join(points, labels, ["cell_id", "lat", "lon"], "left")
    return out.withColumn(name, F.coalesce(name, F.lit(-1)))


# ---- C5, C6: splitting and prototypes ----------------------------------------


def split_dense_cells(
    clustered: DataFrame, max_points: int = K.MAX_CELL_POINTS, min_cluster: int = K.MAX_CLUSTER_POINTS
) -> DataFrame:
    """Turn clusters above ``min_cluster`` points of cells above ``max_points`` into cells of their own.

    The new cell is named by parent and cluster and ``split`` is set, so that it can
    be clustered again with a tighter radius; everything else stays in its cell.
    """
    clustered = cut_lineage(clustered)
    clusters = clustered.groupBy("cell_id", "cluster_id").agg(F.count(F.lit(1)).alias("cluster_n"))
    cells = clusters.groupBy("cell_id").agg(F.sum("cluster_n").alias("cell_n"))
    splits = clusters.join(cells, "cell_id").select(
        "cell_id",
        "cluster_id",
        ((F.col("cell_n") > max_points) & (F.col("cluster_n") > min_cluster)).alias("split"),
    )
    marked = clustered.join(splits, ["cell_id", "cluster_id"])
    renamed = F.concat_ws("_", F.col("cell_id").cast("string"), F.col("cluster_id").cast("string"))
    return marked.withColumn("cell_id", F.when(F.col("split"), renamed).otherwise(F.col("cell_id").cast("string")))


def split_and_cluster(
    clustered: DataFrame,
    max_points: int = K.MAX_CELL_POINTS,
    min_cluster: int = K.MAX_CLUSTER_POINTS,
    eps: float | None = None,
    min_points: int = K.CLUSTER_MIN_POINTS,
) -> DataFrame:
    """:func:`split_dense_cells`, and the new cells are clustered again.

    Give a tighter ``eps`` than the first time; without it each new cell uses the
    median of its own core distances.  Rows that stay keep their cluster.
    """
    marked = cut_lineage(split_dense_cells(clustered, max_points, min_cluster))
    again = density_clusters(marked.where("split").drop("cluster_id"), eps, min_points)
    again = again.withColumn("cluster_id", F.col("cluster_id").cast(marked.schema["cluster_id"].dataType))
    return marked.where("NOT split").unionByName(again)


def prototype_table(clustered: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row per (geocell_index, cluster_id): names, member count and the cell's centroid.

    The centroid is the geometric one where ``cells`` knows the cell, otherwise the
    mean of its points.  Members are listed by :func:`prototype_members`.
    """
    keys = ["country", "admin1", "cell_id"]
    index = geocell_index(clustered)
    counts = clustered.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("count"))
    means = clustered.groupBy(*keys).agg(F.avg("lat").alias("m_lat"), F.avg("lon").alias("m_lon"))
    rows = counts.join(index.join(means, keys), keys)
    if cells is None:
        rows = rows.withColumns({"g_lat": F.lit(None).cast("double"), "g_lon": F.lit(None).cast("double")})
    else:
        shape = cells.select("cell_id", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
        rows = rows.join(shape, "cell_id", "left")
    return rows.select(
        "geocell_index",
        *keys,
        "cluster_id",
        "count",
        F.coalesce("g_lat", "m_lat").alias("centroid_lat"),
        F.coalesce("g_lon", "m_lon").alias("centroid_lng"),
    )


def prototype_members(clustered: DataFrame, chunk: int = 1000) -> DataFrame:
    """Sorted member ids per (geocell_index, cluster_id), in numbered lists of at most ``chunk`` ids."""
    keys = ["country", "admin1", "cell_id"]
    indexed = clustered.join(geocell_index(clustered), keys)
    group = ["geocell_index", "cluster_id"]
    ranked = rank_in_group(indexed.select(*group, "point_id"), group, [F.col("point_id")], "_at")
    ranked = ranked.withColumn("chunk", F.floor((F.col("_at") - 1) / chunk))
    return ranked.groupBy(*group, "chunk").agg(F.array_sort(F.collect_list("point_id")).alias("indices"))
