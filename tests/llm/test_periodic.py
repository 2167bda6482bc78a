"""Runs against a brute-force search of all stretches."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st

from geolens.llm import periodic
from geolens.llm.queries import QUERIES
from geolens.llm.words import Texts

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(words, least=12):
    """For each distance the stretches on which words so far apart are equal, and of equal stretches the first."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def compare(texts, least=12):
    runs, collapsed = periodic.search(Texts(pa.array(texts, pa.string())), least)
    for text, found, short in zip(texts, runs.to_pylist(), collapsed.to_pylist(), strict=True):
        words = words_of(text)
        want = brute(words, least)
        assert [(r["start"], r["length"], r["period"]) for r in found] == want
        assert short == " ".join(kept_words(words, want))


small = st.lists(st.sampled_from("ab"), max_size=60)
tiled = st.tuples(small, st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(0, 12), small).map(lambda x: x[0] + x[1] * x[2] + x[3])
nested = st.lists(tiled, min_size=1, max_size=3).map(lambda x: [w for part in x for w in part])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(small, tiled, nested).map(" ".join), max_size=6), st.sampled_from([12, 12, 2, 5, 7]))
@example(["a " * 40, "", "b " * 11, "b " * 12], 12)
def test_short_texts(texts, least):
    compare(texts, least)


def test_odd_texts():
    compare([None, "", "  \n", "a", "a b " * 100, "a b " * 100 + "a", "x " + "a b c " * 9 + "y", "é ü " * 13, "\x0b".join("abc" * 8)])
    compare([])
    long = " ".join(["w%d" % (i % 301) for i in range(2000)])
    compare([long, long + " end", " ".join(["p q r s t u v"] * 3 + ["z"] + ["p q r s t u v"])])


def test_fibonacci_and_random_words():
    a, b = "a", "a b"
    for _ in range(9):
        a, b = b, f"{b} {a}"
    rng = np.random.default_rng(3)
    compare([b] + [" ".join(rng.choice(list("abc"), 400, p=[0.8, 0.1, 0.1])) for _ in range(10)])


def test_one_word_repeated_in_a_long_text():
    runs, collapsed = periodic.search(Texts(pa.array(["a " * 300_000])))
    assert runs.to_pylist() == [[{"start": 0, "length": 300_000, "period": 1}]] and collapsed.to_pylist() == ["a"]


def test_many_copies_of_a_passage_are_not_paired():
    rng = np.random.default_rng(4)
    text = " ".join(" ".join(f"n{x}" for x in rng.integers(0, 10**6, 20)) + " of a passage that stands here again and again " for _ in range(5_000))
    runs, _ = periodic.search(Texts(pa.array([text])))
    assert runs.to_pylist() == [[]]


def planted(doc, text):
    words, h = words_of(text), zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    assert sum(r["n_runs"] > 0 for r in rows.values()) > len(docs) // 20
    for d in docs:
        words = planted(d["doc_id"], d["text"])
        if len(words) > 1500:
            continue
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = rows[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest()


def test_defined_cases(spark):
    rows = [(1, None, 1), (None, "b " * 20, 2), (None, "b " * 20, 2), (4, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "`c0`.x")
    found = periodic.find_runs(docs.toDF("doc_id", "text", "runs")).collect()
    assert sorted((len(r["runs"]), r["collapsed"]) for r in found) == [(0, ""), (0, ""), (1, "b"), (1, "b")]
    assert periodic.find_runs(docs.toDF("c0", "text", "text2").limit(0)).collect() == []
