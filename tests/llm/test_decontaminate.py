import re

import pytest

from geolens.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        x = words(item)
        size = min(10, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
        for p in range(len(w) - size + 1):
            if tuple(w[p : p + size]) in windows:
                hit |= set(range(p, p + size))
                names.add("" if name is None else str(name))
    return len(w), hit, sorted(names)


LONG = [f"w{i}" for i in range(30)]
ITEMS = [(1, " ".join(LONG)), (2, "Only THREE words"), (3, None), (4, " ., "), (None, "null item here now"), (10, "Ünder-score_42 ok"), (2, "only three words"), (5, " ".join(LONG[5:17]))]
DOCS = [
    (1, "x " + " ".join(LONG[3:14]) + " y"),
    (2, " ".join(LONG[:9]) + " z " + " ".join(LONG[9:])),
    (3, "ONLY, three...words! only three words"),
    (4, None),
    (5, ""),
    (6, "null item here now; ünder score 42 ok; Ünder_score-42 ok"),
    (7, "a " * 60_000 + "only three words"),
    (8, " ".join(LONG) + " " + " ".join(LONG)),
    (8, " ".join(LONG) + " " + " ".join(LONG)),
    (None, "only three"),
]


@pytest.mark.parametrize("at_once", [D.WINDOWS_AT_ONCE, 7])
def test_hits(spark, at_once):
    docs = spark.createDataFrame([(k, t, "own") for k, t in DOCS], "doc_id long, text string, hits string")
    found = D.find_hits(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), windows_at_once=at_once)
    got = sorted((repr(r["doc_id"]), r["n_words"], [k for h in r["hits"] for k in range(h["first"], h["last"] + 1)], list(r["items"])) for r in found.collect())
    assert got == sorted((repr(k), n, sorted(hit), names) for k, t in DOCS for n, hit, names in [plain(t, ITEMS)])


def test_removal_leaves_no_hits_and_clean_text_alone(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    cut = D.remove_hits(D.find_hits(docs, items))
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == "x  y" and texts[4] is None and texts[5] == "" and texts[None] == "only three"
    assert D.find_hits(cut.select("doc_id", "text"), items).where("size(hits) > 0").count() == 0
    assert D.drop_hit_documents(D.find_hits(docs, items)).count() == sum(not plain(t, ITEMS)[1] for _, t in DOCS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_hits(docs.limit(0), items).count() == 0
    assert D.find_hits(docs, items.limit(0)).where("size(hits) = 0").count() == len(DOCS)
