import functools

from geolens.llm import token_counts as T
from geolens.llm.queries import QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.001"
PATH = vocabulary("piece_bpe_32k.model")
TEXTS = [None, "", " \n", "the cat the cats", "漢字かな👍🏽", "a\x00b", "x" * 3000, "wörd-Wörd's 12,5 \x85 z", "the\tthe\x0bthen theses these"]


@functools.cache
def known():
    return T.Vocabulary(PATH)


@functools.cache
def cheapest(word):
    """(cost, tokens) by a table over all cuts of the word."""
    v, word = known(), T.BEGIN + word
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * T.BYTE_COST, best[end - 1][1] + n)]
        for begin in range(max(0, end - v.longest), end):
            if word[begin:end] in v.cost:
                options.append((best[begin][0] + v.cost[word[begin:end]], best[begin][1] + 1))
        best.append(min(options))
    return best[-1]


def plain(text):
    words = [w.decode() for w in (text or "").encode().split()]
    return len(words), sum(cheapest(w)[1] for w in words)


def test_given_documents(spark):
    want = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in QUERIES["op8_token_counts"](spark, FOLDER).collect()}
    assert got == want


def test_odd_rows_and_a_small_trie(spark, monkeypatch):
    frame = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "own")], "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in T.count_tokens(frame, PATH).collect())
    assert got == sorted([(i, *plain(t)) for i, t in enumerate(TEXTS)] + [(3, *plain(TEXTS[3]))])
    assert T.count_tokens(frame.limit(0), PATH).count() == 0
    small = T.Trie(known())
    monkeypatch.setattr(T, "NODES", 10)
    assert [small.count(w.encode()) for t in TEXTS for w in (t or "").split()] == [cheapest(w)[1] for t in TEXTS for w in (t or "").split()]


def test_prefixes_are_scored_once():
    trie = T.Trie(known())
    for word in (b"prefix", b"prefixes", b"prefixed", b"prefix"):
        trie.count(word)
    assert len(trie.parent) == 1 + len("▁prefix") + len("es") + len("d")
