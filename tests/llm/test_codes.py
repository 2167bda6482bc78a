"""Product codes against plain Lloyd rounds in whole numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from geolens.llm import codes
from geolens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows, parts=4, entries=256, rounds=4):
    """(row number, code, error) for rows (id, vector), and all final components."""
    kept = [(i, r[0], [math.floor(1024 * x) for x in r[1]]) for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], []
    width = len(kept[0][2]) // parts
    start = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    code, error, flat = defaultdict(str), defaultdict(int), []
    for p in range(parts):
        rows_p = [r[2][p * width : (p + 1) * width] for r in kept]
        book = [r[2][p * width : (p + 1) * width] for r in start]
        for k in range(rounds + 1):
            best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book)) for v in rows_p]
            if k < rounds:
                for e in range(len(book)):
                    own = [v for v, b in zip(rows_p, best, strict=True) if b[1] == e]
                    if own:
                        book[e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
        for (i, _, _), (d, e) in zip(kept, best, strict=True):
            code[i] += f"{e:02x}"
            error[i] += d
        flat += [x for c in book for x in c]
    return [(i, code[i], error[i]) for i, _, _ in kept], flat


def vectors(n, seed, width=8, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=width) * scale], int(rng.integers(0, 3)) or None) for i in range(n)]


def compare(spark, rows, **how):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, vec_id long, embedding array<float>, label int").repartition(3)
    exact = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]]) for r in rows]
    want, flat = brute(exact, **how)
    found = codes.compress(frame, **how)
    assert sorted((r["n"], r["code"], r["error"]) for r in found.frame.collect()) == want
    assert found.codebooks.ravel().tolist() == flat
    return found


def test_small_tables(spark):
    compare(spark, vectors(60, 1), entries=7)
    compare(spark, vectors(20, 2, width=4, scale=0.002), entries=16, rounds=6)  # many ties
    compare(spark, vectors(5, 3), entries=9)
    compare(spark, vectors(30, 4), parts=2, entries=4, rounds=0)


def test_nulls_repeats_and_odd_numbers(spark):
    rows = vectors(12, 5)
    rows += [(3, rows[3][1], 1)] * 4 + [(None, rows[0][1], None), (None, rows[1][1], None), (90, None, 1), (91, [], 1), (92, [None] + [0.0] * 7, 1), (93, [float("nan")] * 8, 1), (94, [float("-inf")] * 8, 1)]
    compare(spark, rows, entries=5)
    compare(spark, rows, entries=200)


def test_one_entry_holds_nearly_all(spark):
    rows = [(i, [0.25] * 8, 1) for i in range(400)] + vectors(30, 6)
    compare(spark, rows, entries=10)


def test_large_components_stay_exact(spark):
    compare(spark, vectors(25, 7, scale=20_000.0), entries=6, rounds=3)
    with pytest.raises(ValueError):
        compare(spark, vectors(3, 8, scale=1e9))


def test_lengths_that_cannot_be_cut(spark):
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 4), (2, [1.0] * 8)], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 6)], "vec_id long, embedding array<float>"))


def test_empty_table_and_other_columns(spark):
    none = codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, code int"))
    assert none.frame.collect() == [] and none.frame.columns == ["vec_id", "embedding", "code", "error"]
    rows = [(i, [float(i)] * 4, "own", i) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, `a b` string, row int")
    found = codes.compress(frame)
    assert [tuple(r) for r in found.frame.select("row", "a b", "code", "error").orderBy("row").collect()] == [(i, "own", f"{i:02x}" * 4, 0) for i in range(3)]


def test_totals(spark):
    frame = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (None, 1), (2, 0)], "label int, error long")
    for few in (100, 1):
        codes.FEW_LABELS = few
        got = sorted((str(r["label"]), r["error"], r["label_error"]) for r in codes.with_totals(frame, "label").collect())
        assert got == [("1", 5, 11), ("1", 6, 11), ("2", 0, 0), ("None", 1, 8), ("None", 7, 8)]
    codes.FEW_LABELS = 100_000


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    want, flat = brute([(r["vec_id"], r["embedding"]) for r in rows])
    got = {r["vec_id"]: r for r in QUERIES["op11_vector_codes"](spark, FOLDER).collect()}
    total = defaultdict(int)
    for i, _, error in want:
        total[rows[i]["label"]] += error
    digest = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    assert len(got) == len(want)
    for i, code, error in want:
        r = got[rows[i]["vec_id"]]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == (code, error, total[rows[i]["label"]], digest)
