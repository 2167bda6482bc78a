"""Quality rules against a plain recount and a plain Jensen-Shannon distance."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from geolens.llm import rules
from geolens.llm.queries import QUERIES
from geolens.llm.words import NOT_SPACE, Texts, Words

FOLDER = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"
CLASS_SIGNS = ".,;:!?'\"()-"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def counted(text):
    text = text or ""
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts_of_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:7] for r in QUERIES["op10_quality_rules"](spark, FOLDER).collect()}
    assert got == {k: counted(v) for k, v in docs.items()}


def class_of(c):
    if ord(c) > 127:
        return 4
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c == "\n":
        return 8
    if c in " \t\r\x0b\x0c":
        return 3
    return 5 if c in "#*$%&|<>" else 7 if c in CLASS_SIGNS else 6


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def hash_of(word):
    """Words of equal counts are ranked by their hashes."""
    return int(Words(Texts(pa.array([word])), NOT_SPACE, lower=False).hashes().view("int64")[0])


def distance(p, q):
    a, b = sum(p.values()), sum(q.values())
    out = 0
    for k in {*p, *q}:
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        out += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return math.sqrt(max(out, 0))


def test_distances_against_plain_ones(spark):
    small = rules.Rules(min_reference_words=200, common_words=16)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    classes, common, total = {}, {}, Counter()
    for r in rows:
        if not counted(r["text"])[-1]:
            classes.setdefault(r["lang"], Counter()).update(map(class_of, r["text"]))
            words = words_of(lower(r["text"]))
            common.setdefault(r["lang"], Counter()).update(words)
            total[r["lang"]] += len(words)
    tops = {}
    for lang, c in common.items():
        key = lambda kv: (-kv[1], hash_of(kv[0]))
        tops[lang] = dict(sorted(c.items(), key=key)[:16])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = 0
    for r in rules.quality(docs, small).collect():
        lang, text = r["lang"], r["text"]
        if total[lang] < 200:
            assert r["class_distance"] is None and r["word_distance"] is None
            continue
        if len(text) >= small.min_chars:
            assert r["class_distance"] == pytest.approx(distance(Counter(map(class_of, text)), classes[lang]), abs=1e-9)
        else:
            assert r["class_distance"] is None
        words = words_of(lower(text))
        if len(words) >= small.min_judged_words:
            top = tops[lang]
            mine = Counter(w if w in top else None for w in words)
            reference = {**top, None: total[lang] - sum(top.values())}
            assert r["word_distance"] == pytest.approx(distance(mine, reference), abs=1e-9)
            seen += 1
        far = (r["class_distance"] or 0) > small.max_class_distance or (r["word_distance"] or 0) > small.max_word_distance
        assert r["kept"] == (not r["base_failed"] and not far)
    assert seen > 20


def test_more_languages_than_fit_at_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    one = rules.quality(docs, rules.Rules(min_reference_words=200))
    several = rules.quality(docs, rules.Rules(min_reference_words=200, languages_at_once=1))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, several.collect()))


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "", "en", "y"), (None, "a b", "en", "z"), (4, "wort " * 30_000, None, None), (4, "wort " * 30_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = rules.quality(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in got] == [
        (None, 2, True, False), (1, 0, True, False), (2, 0, True, False), (4, 30_000, True, False), (4, 30_000, True, False)
    ]
    assert rules.quality(docs.limit(0)).count() == 0


def test_base_rule_boundaries(spark):
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(words[:9]), " ".join(words[:10]), " ".join(words[:5] + ["x"] + words[:5]), "\t".join(words) + "\x0b" + " ".join(words), "a b\n\na b\n \n \nc"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.quality(docs).collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}


def test_long_words_of_any_script_are_common_words(spark):
    """Two vocabularies of twelve-letter Cyrillic words: a text of the other one is far from the language."""
    first = ["".join(chr(0x430 + (7 * i + 5 * k + i * k) % 32) for k in range(12)) for i in range(40)]
    other = [w[::-1] + "\u0451" for w in first]
    said = lambda words, k: " ".join(np.random.default_rng(k).choice(words, 120))
    rows = [(i, said(first, i), "ru") for i in range(200)] + [(1000, said(other, 3), "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["word_distance"], r["kept"]) for r in rules.quality(docs).collect()}
    assert got[1000][0] > 0.52 and not got[1000][1]
    assert all(d < 0.35 and kept for k, (d, kept) in got.items() if k < 1000)
