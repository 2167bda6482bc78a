"""Geocell building against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geolens.operators import geocells


def frame(spark, points):
    return spark.createDataFrame(points, "point_id long, cell_id long, lat double, lon double")


def crowded(seed, n=240):
    """Three cells: a tight blob with many copies, chains, and sparse scatter."""
    rng = random.Random(seed)
    points = []
    for i in range(n):
        kind = i % 6
        if kind < 2:
            spot = (1 + rng.randrange(5) * 0.02, 1 + rng.randrange(5) * 0.02)
        elif kind == 2:
            spot = (2.0 + (i // 6) * 0.11, 3.0)
        elif kind == 3:
            spot = (rng.gauss(5, 0.25), rng.gauss(5, 0.25))
        else:
            spot = (rng.uniform(0, 9), rng.uniform(0, 9))
        points.append((i, 1 if i % 3 else 2, *spot))
    return points + [(1000 + i, 3, 4.0, 4.0) for i in range(4)] + [(2000 + i, 4, 0.5, 0.5) for i in range(30)]


def gap(a, b):
    return math.sqrt((a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3]))


def brute_clusters(points, eps, min_points):
    labels = {}
    by_cell = defaultdict(list)
    for p in points:
        by_cell[p[1]].append(p)
    for cell in by_cell.values():
        near = {p[0]: [q[0] for q in cell if gap(p, q) <= eps] for p in cell}
        core = {i for i, js in near.items() if len(js) >= min_points}
        root = {}
        for start in sorted(core):
            if start in root:
                continue
            stack = [start]
            while stack:
                i = stack.pop()
                if i not in root:
                    root[i] = start
                    stack.extend(j for j in near[i] if j in core)
        number = {r: n for n, r in enumerate(sorted(set(root.values())))}
        for p in cell:
            roots = [root[p[0]]] if p[0] in core else [root[j] for j in near[p[0]] if j in core]
            labels[p[0]] = number[min(roots)] if roots else -1
    return labels


@pytest.mark.parametrize("eps", [0.03, 0.12, 0.3, 0.8, 3.0])
def test_density_clusters_against_brute_force(spark, eps):
    points = crowded(int(eps * 100))
    got = geocells.density_clusters(frame(spark, points), eps=eps, min_points=5)
    assert {r["point_id"]: r["cluster_id"] for r in got.collect()} == brute_clusters(points, eps, 5)


def test_crowded_squares_just_within_and_just_out_of_reach(spark):
    """Two crowds whose closest members decide; deeper levels of the search are needed."""
    rng = random.Random(1)
    eps = 1.0
    for shift in (0.9995, 1.0005):
        left = [(i, 1, rng.uniform(0, 0.6), -rng.uniform(0, 0.25)) for i in range(60)] + [(100, 1, 0.3, 0.0)]
        right = [(200 + i, 1, rng.uniform(0, 0.6), shift + rng.uniform(0.002, 0.25)) for i in range(60)] + [(300, 1, 0.3, shift)]
        points = left + right
        got = geocells.density_clusters(frame(spark, points), eps=eps)
        assert {r["point_id"]: r["cluster_id"] for r in got.collect()} == brute_clusters(points, eps, 5)


def test_core_distance_against_brute_force(spark):
    points = crowded(9) + [(5000 + i, 9, 1.0 + i * 1e-4, 1.0) for i in range(40)] + [(6000, 9, 80.0, -170.0)]
    got = {r["point_id"]: r["core"] for r in geocells.core_distance(frame(spark, points), 5, "core").collect()}
    for p in points:
        gaps = sorted(gap(p, q) for q in points if q[1] == p[1])
        assert got[p[0]] == (None if len(gaps) < 5 else pytest.approx(gaps[4], abs=1e-12))


@pytest.mark.parametrize("listed", [0, 512])
def test_core_distance_beside_crowds_and_without_coordinates(spark, monkeypatch, listed):
    monkeypatch.setattr(geocells, "LISTED", listed)  # with 0, lone points beside the crowd are joined pair by pair
    rng = random.Random(3)
    points = [(i, 1, rng.random() * 0.01, rng.random() * 0.01) for i in range(300)]
    points += [(1000 + i, 1, rng.random() * 20, rng.random() * 20) for i in range(60)]
    lost = [(2000, 1, None, 3.0), (2001, 1, 4.0, None), (2002, 2, None, None)]
    got = {r["point_id"]: r["core"] for r in geocells.core_distance(frame(spark, points + lost), 5, "core").collect()}
    want = {p[0]: pytest.approx(sorted(gap(p, q) for q in points)[4], abs=1e-12) for p in points}
    assert got == want | {p[0]: None for p in lost}


def test_core_distance_shuffles_no_pairs(spark):
    rng = random.Random(4)
    points = frame(spark, [(i, 1, rng.random() * 50, rng.random() * 50) for i in range(4000)])
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    geocells.core_distance(points, 5, "core").collect()
    assert sum(n for stage, n in written().items() if stage not in before) < 20 * 4000


def test_connected_components_of_chain_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(7, i) for i in range(1, 30) if i != 7] + [(900, 800), (800, 901)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["root"] for r in geocells.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 100 for i in range(100, 165)} | {i: 1 for i in range(1, 30)} | {800: 800, 900: 800, 901: 800}
    assert got == want


def test_rect_partition_stops_at_identical_points(spark):
    points = [(i, 1, 5.0, 5.0) for i in range(50)] + [(100 + i, 1, float(i), 2.0 * i) for i in range(10)]
    leaves = geocells.rect_partition(frame(spark, points), 8).collect()
    assert sum(r["n_points"] for r in leaves) == 60
    assert all(r["n_points"] <= 8 or (r["min_lat"] == r["max_lat"] and r["min_lon"] == r["max_lon"]) for r in leaves)
    assert len(geocells.rect_partition(frame(spark, points[:1]), 8).collect()) == 1


def brute_merge(counts, edges, min_points, seed=42):
    """The same rule, one round after the other, on plain dictionaries."""
    size, links = dict(counts), {c: set() for c in counts}
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    root, turn = {c: c for c in counts}, 0
    while True:
        wish = {c: min(links[c]) for c in size if size[c] < min_points and links[c]}
        rank = {c: hashlib.md5(f"{seed}:{turn}:{c}".encode()).hexdigest() for c in wish}
        best = {}
        for c, other in wish.items():
            for cell in (c, other):
                best[cell] = min(best.get(cell, rank[c]), rank[c])
        moves = {o: c for c, o in wish.items() if best[c] == rank[c] == best[o]}
        if not moves:
            return root
        for old, new in moves.items():
            size[new] += size.pop(old)
            for n in links.pop(old):
                if n in links:
                    links[n].discard(old)
                    if n != new:
                        links[n].add(new)
                        links[new].add(n)
            links[new].discard(new)
            root = {c: new if r == old else r for c, r in root.items()}
        turn += 1


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_sparse_cells(spark, seed):
    rng = random.Random(seed)
    side, n = 6, 36
    counts = {c: rng.choice([0, 0, 1, 3, 8, 12, 40]) for c in range(n)} | {100: 2, 101: 3, 200: 1}
    edges = [(c, c + 1) for c in range(n) if c % side < side - 1] + [(c, c + side) for c in range(n - side)] + [(100, 101)]
    cells = spark.createDataFrame(list(counts.items()), "cell_id long, n_points long")
    both = edges + [(b, a) for a, b in edges]
    merged = geocells.merge_sparse_cells(cells, spark.createDataFrame(both, "src long, dst long"), 10)
    root = {r["cell_id"]: r["root"] for r in merged.collect()}
    assert root == brute_merge(counts, edges, 10)
    totals = defaultdict(int)
    for cell, r in root.items():
        totals[r] += counts[cell]
    assert sum(totals.values()) == sum(counts.values())
    assert all(t >= 10 for r, t in totals.items() if r < n)
    assert totals[root[100]] == 5 and root[200] == 200


def test_split_thresholds(spark):
    rows = []
    for cell, sizes in {1: [60, 7], 2: [57, 11], 3: [68 - 10, 10]}.items():
        for cluster, size in enumerate(sizes):
            rows += [(len(rows) + i, cell, cluster) for i in range(size)]
    clustered = spark.createDataFrame(rows, "point_id long, cell_id long, cluster_id long")
    counts = {(r["cell_id"]): r["count"] for r in geocells.split_dense_cells(clustered).groupBy("cell_id").count().collect()}
    assert counts == {"1": 67, "2_0": 57, "2_1": 11, "3": 10, "3_0": 58}


def test_prototype_members_are_chunked_and_complete(spark):
    rows = [(i, "c", "a", "big" if i % 3 else "small", i % 2, 1.0, 2.0) for i in range(100)]
    clustered = spark.createDataFrame(
        rows, "point_id long, country string, admin1 string, cell_id string, cluster_id long, lat double, lon double"
    )
    got = geocells.prototype_members(clustered, 7).collect()
    assert sorted(i for r in got for i in r["indices"]) == list(range(100))
    assert max(len(r["indices"]) for r in got) == 7
    table = geocells.prototype_table(clustered).collect()
    assert {(r["geocell_index"], r["cluster_id"]): r["count"] for r in table}[(0, 0)] == 33
    assert all((r["centroid_lat"], r["centroid_lng"]) == (1.0, 2.0) for r in table)


def test_halving_ends_on_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    a, b = 1 + 2**-52, 1 + 2**-51  # the middle rounds to the larger one
    rows = [(nan, 0.0), (inf, 1.0), (0.0, -inf), (None, 1.0), (a, 0.0), (b, 0.0), (a, 0.0)]
    frame = spark.createDataFrame(rows, "lat double, lon double")
    got = sorted((r["min_lat"], r["max_lat"], r["n_points"]) for r in geocells.rect_partition(frame, 1).collect())
    assert got == [(a, a, 2), (b, b, 1)]
    assert geocells.rect_partition(frame.limit(4), 1).count() == 0


def test_split_cells_are_clustered_again(spark):
    rows = [(i, 1, 0, (0.0 if i < 40 else 1.0) + i % 5 * 0.001, 0.0) for i in range(80)]  # two heaps, one cluster
    rows += [(80 + i, 1, 1, 9.0, 9.0) for i in range(10)] + [(90 + i, 2, 3, 5.0, 5.0) for i in range(20)]
    clustered = spark.createDataFrame(rows, "point_id long, cell_id long, cluster_id long, lat double, lon double")
    got = {r["point_id"]: (r["cell_id"], r["cluster_id"]) for r in geocells.split_and_cluster(clustered, eps=0.1).collect()}
    assert got == {i: ("1_0", int(i >= 40)) if i < 80 else ("1", 1) if i < 90 else ("2", 3) for i in range(110)}


def test_density_clusters_sends_a_position_to_few_tiles_and_contracts_links(spark):
    rng = random.Random(6)
    points = frame(spark, [(i, 1, rng.random() * 50, rng.random() * 50) for i in range(4000)])
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    geocells.density_clusters(points).collect()
    assert sum(n for stage, n in written().items() if stage not in before) < 30 * 4000


@pytest.mark.parametrize("chunk", [3, 500_000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_contracted_by_place(spark, monkeypatch, chunk, kind):
    monkeypatch.setattr(geocells, "CHUNK", chunk)
    edges = [(i, i + 1) for i in range(100, 164)] + [(107, i) for i in range(110, 130)] + [(900, 800), (800, 901), (500, 501)]
    edges += [(300 + i, 300 + i // 2) for i in range(1, 40)] + [(700, 700)]
    random.Random(2).shuffle(edges)
    rows = [(a, b, a // 10) for a, b in edges]
    typed = spark.createDataFrame(rows, "src long, dst long, place long")
    typed = typed.withColumns({c: F.col(c).cast(kind) for c in ("src", "dst")})
    got = [(int(r["node"]), int(r["root"])) for r in geocells.near_components(typed, ["place"]).collect()]
    want = {i: 100 for i in range(100, 165)} | {i: 300 for i in range(300, 340)} | {800: 800, 900: 800, 901: 800, 500: 500, 501: 500}
    assert len(got) == len(want) and dict(got) == want


def test_core_distance_in_cells_of_unlike_density_and_shape(spark):
    rng = random.Random(8)
    points = [(i, 1, rng.random() * 50, rng.random() * 90) for i in range(150)]
    points += [(1000 + i, 2, 7 + rng.random() * 1e-3, 8 + rng.random() * 1e-3) for i in range(150)]
    points += [(2000 + i, 3, i * 0.5, 4.0) for i in range(100)] + [(3000 + i, 4, 1.0, 1.0 + i * 1e-9) for i in range(12)]
    points += [(4000 + i, 5, 2.0, 2.0) for i in range(4)] + [(4010, 5, 60.0, 80.0)]
    got = {r["point_id"]: r["core"] for r in geocells.core_distance(frame(spark, points), 5, "core").collect()}
    for p in points:
        assert got[p[0]] == pytest.approx(sorted(gap(p, q) for q in points if q[1] == p[1])[4], rel=1e-12, abs=0)


def test_core_distance_without_finite_coordinates(spark):
    nan, inf = float("nan"), float("inf")
    points = [(i, 1, float(i), 2.0) for i in range(6)]
    lost = [(100, 1, nan, 2.0), (101, 1, 1.0, -inf), (102, 1, nan, nan)] + [(200 + i, 2, nan, 1.0) for i in range(6)]
    got = {r["point_id"]: r["core"] for r in geocells.core_distance(frame(spark, points + lost), 5, "core").collect()}
    assert got == {0: 4.0, 1: 3.0, 2: 2.0, 3: 2.0, 4: 3.0, 5: 4.0} | {p[0]: None for p in lost}
