"""The Jaccard join against all pairs, on given documents and on made-up groups of copies."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geolens.llm import jaccard
from geolens.llm.queries import QUERIES
from geolens.llm.words import Texts

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def expected(docs):
    """doc_id -> (set size, smallest reachable id), from all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def found(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def test_given_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert found(QUERIES["op1_jaccard_join"](spark, FOLDER)) == expected(docs)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            words.insert(k, f"n{rng.randrange(10**6)}")
        elif words and kind == 1:
            words.pop(min(k, len(words) - 1))
        elif words:
            words[min(k, len(words) - 1)] = f"n{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_copies_of_all_sizes(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)  # large buckets from four sets on
    rng = random.Random(seed)
    texts = []
    for size in [*range(1, 30), 40, 60, 100, 200, 400]:
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(rng.randrange(2, 6)):
            texts.append(" ".join(edited(rng, words, rng.randrange(0, max(2, size // 40 + 2)))))
    chain = [f"c{i}" for i in range(150)]
    for _ in range(25):  # neighbours are linked, ends are not
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    crowd = [f"k{i}" for i in range(90)]
    texts += [" ".join(edited(rng, crowd, rng.randrange(0, 4))) for _ in range(60)]
    shared = " ".join(f"p{i}" for i in range(50))
    texts += [shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 60))) for _ in range(40)]
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id long, text string").repartition(4)
    assert found(jaccard.near_duplicates(frame)) == expected(docs)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, "A b", 0), (9, "a  B", 0), (5, "a b c d e", 0), (None, "a b", 0), (6, "x " * 50_000, 0), (6, "x " * 50_000, 0), (7, "ab", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(map(tuple, jaccard.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (9, 1, 4), (5, 2, 5), (None, 1, 4), (6, 1, 6), (6, 1, 6), (7, 1, 7)], key=repr)
    assert jaccard.near_duplicates(frame.limit(0)).count() == 0


def test_bands_hold_linked_pairs():
    found = jaccard.bands(100_000)
    assert [b[0] for b in found[1:]] == [b[1] + 1 for b in found[:-1]]
    lows = np.array([b[0] for b in found])
    for x in [*range(1, 400), 1000, 5000, 70_000]:
        for y in {x, x + 1, x * 100 // 85 - 1, x * 100 // 85}:
            if y < x:
                continue
            a, b = np.searchsorted(lows, [x, y], side="right") - 1
            assert b - a in (0, 1)
            # the largest difference of linked sets of these sizes
            worst = max((x + y - 2 * k for k in range(x + 1) if 100 * k >= 85 * (x + y - k)), default=-1)
            assert worst <= found[a][2]


@pytest.mark.parametrize("light", [0, 1])
def test_every_linked_pair_meets(light, monkeypatch):
    """The pigeonhole itself, where few shingles make segments that are empty or hold one."""
    monkeypatch.setattr(jaccard, "light_limit", lambda *_: light)
    rng = np.random.default_rng(light)
    plan = jaccard.Allocation(2000, 85, small=8)
    for trial in range(400):
        n = int(rng.integers(6, 120))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        a = np.unique(a)
        most = max(k for k in range(n + 1) if 100 * (n - k // 2) >= 85 * (n + k - k // 2) and k // 2 <= n) if n else 0
        out = int(rng.integers(0, most // 2 + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[out:], rng.integers(0, 2**63, most // 2 - out + 1 if most else 0).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        sets = jaccard.Sets(Texts(pa.array(["", ""])), 4, 0)
        sets.tokens, sets.owner = np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)])
        sets.size, sets.ids = np.array([len(a), len(b)]), np.array([1, 2])
        if np.array_equal(a, b):
            continue
        key, id_, active = jaccard.signatures(sets, np.ones(2, bool), plan)
        mine = {k: x for k, i, x in zip(key.tolist(), id_.tolist(), active.tolist()) if i == 1 for x in [x]}
        met = any(k in mine and (x or mine[k]) for k, i, x in zip(key.tolist(), id_.tolist(), active.tolist()) if i == 2)
        assert met, (trial, len(a), len(b), both)


def test_sketches_drop_false_candidates_and_no_link(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + [f"a{i}_{k}" for k in range(n)]) for i, n in enumerate((30, 90, 91, 120, 260, 270, 300, 1000, 1010, 3000, 4000))]
    for n in (12, 62, 70, 130, 250, 500, 530, 2040, 2060):  # of these also edited copies, some with sketches of other lengths
        words = [f"b{n}_{k}" for k in range(n)]
        texts += [" ".join(words)] + [" ".join(edited(rng, words, e)) for e in (1, 2, n // 60, n // 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shapes = jaccard.set_sizes(docs, "text", "doc_id", 4, 0).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    every = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    left = {(r["a"], r["b"]) for r in jaccard.possible(spark.createDataFrame(every, "a long, b long"), shapes).collect()}
    sets = [shingles(t) for t in texts]
    linked = {(a, b) for a, b in every if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked <= left and len(linked) > 30
    assert not [(a, b) for a, b in left if not sets[a] & sets[b] and len(sets[b]) > 50]
    assert not [(a, b) for a, b in left if b < 11 and len(sets[a]) > 100]  # these share the passage only
