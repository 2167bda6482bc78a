"""The pipeline stage by stage, each held against what its input asks for."""

import itertools
import random
import re

import pytest

import corpus_pipeline as P
from geolens.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(cut_lineage(stage(spark, seen[-1], FOLDER)))
    assert all(df.columns == COLUMNS for df in seen[:-1])
    raw, good, single, clean, masked, packed = seen
    from geolens.llm import decontaminate, jaccard, packing, rules, secrets

    kept = {r["doc_id"] for r in rules.quality(raw).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in jaccard.near_duplicates(good).collect()}
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    dirty = {r["doc_id"] for r in decontaminate.find_hits(single, benchmark).where("size(hits) > 0").collect()}
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (single, clean))
    assert dirty and decontaminate.find_hits(clean, benchmark).where("size(hits) > 0").count() == 0
    assert all(after[k] == before[k] for k in before.keys() - dirty)
    assert all(after[k]["n_chars"] == len(after[k]["text"]) for k in dirty & after.keys())
    assert secrets.scan(masked, None).where("base_spans <> ''").count() == 0
    assert {r["doc_id"] for r in masked.collect()} == set(after)
    assert sorted(map(tuple, packed.drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, packing.pieces(masked, P.vocabulary("word_bpe_49k.json")).drop("row").collect())
    )
    final = P.run(spark, FOLDER)
    assert sorted(map(repr, final.drop("sequence_id", "offset").collect())) == sorted(map(repr, packed.drop("sequence_id", "offset").collect()))


TEXT = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_clashing_names(spark, empty):
    rows = [(1, TEXT, "en", "s", None, "a"), (1, TEXT, "en", "s", 5, "a"), (2, TEXT + " end", None, None, 3, None), (None, TEXT + " more", "en", "s", 1, "b"), (None, None, None, None, None, None), (4, "", "en", "s", 0, "c")]
    rows.append((5, "token = " + "0123abcd" * 5 + " " + " ".join(f"other{i}" for i in range(40)), "en", "s", 9, "d"))
    names = ["kept", "hits", "items", "spans", "id", "row", "label", "secret_bytes", "_key"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, note string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    docs = cut_lineage(docs.limit(0) if empty else docs)
    for k, (_, stage) in enumerate(P.STAGES):
        out = cut_lineage(stage(spark, docs, FOLDER))
        if k < 4:
            assert out.columns == docs.columns
        if not empty and k == 1:
            assert sorted((r["doc_id"], r["note"]) for r in out.collect()) == [(1, "a"), (5, "d")]
        if not empty and k == 3:
            assert re.match(r"\[SECRET\] other0 ", out.where("doc_id = 5").first()["text"])
        docs = out
    assert docs.count() == (0 if empty else 2)


def kept_by_all_pairs(docs):
    """Ids that are the smallest of their group, linked by 5-word shingles and a similarity of 0.8."""
    sets, smallest = {}, {d: d for d in docs}
    for d, text in docs.items():
        w = text.lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    def find(x):
        while smallest[x] != x:
            x = smallest[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            smallest[y] = x
    return {d for d in docs if find(d) == d}


def test_near_duplicates_link_five_words_at_four_fifths(spark):
    rng = random.Random(3)
    docs = {}
    for n in (5, 12, 25, 46, 50, 60, 100, 200, 400):
        base = [f"b{n}x{i}" for i in range(n)]
        one = [*base[: n // 2], "other", *base[n // 2 + 1 :]]
        longer = [[*base, *(f"more{n}y{i}" for i in range(round(n * x)))] for x in (0.16, 0.18, 0.2, 0.23, 0.26, 0.4)]
        edited = []
        for edits in (2, 4, 6, 8, 10):
            words = list(base)
            for i in rng.sample(range(n), min(n, edits)):
                words[i] = f"e{rng.randrange(10**6)}"
            edited.append(words)
        for words in (base, one, *longer, *edited):
            docs[len(docs)] = " ".join(words)
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    for ids in (docs.keys(), [d for d in docs if d % 13 in (0, 1)], [d for d in docs if d % 13 in (0, 4)]):
        some = {d: docs[d] for d in ids}
        got = {r["doc_id"] for r in P.near_duplicates(spark, frame.where(frame.doc_id.isin(list(ids))), FOLDER).collect()}
        assert got == kept_by_all_pairs(some)
    assert kept_by_all_pairs({0: docs[13 * 4], 1: docs[13 * 4 + 1]}) == {0}  # one replaced word in 50


def test_no_document_is_lost_among_equal_and_missing_ids(spark):
    text = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"]
    rows = [(42, text[0]), (None, None), (7, text[1]), (7, text[2]), (8, text[3]), (None, text[4]), (None, text[5]), (None, text[4]), (7, text[1]), (9, ""), (9, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(repr, ((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, FOLDER).collect())))
    assert got == sorted(map(repr, set(rows)))
    near = [(None, text[0]), (3, text[0]), (5, text[0] + " end")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in near], docs.schema)
    assert [r["doc_id"] for r in P.near_duplicates(spark, docs, FOLDER).collect()] == [3]
