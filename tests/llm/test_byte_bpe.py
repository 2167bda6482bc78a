"""Encoding against the public library, decoding as an exact round trip."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from geolens.llm import byte_bpe
from geolens.llm.queries import QUERIES, vocabulary
from geolens.llm.words import Texts

FOLDER = "/root/testdata/sf0.001"
RANKS = vocabulary("byte_bpe_50k.tiktoken")
ENCODER = byte_bpe.Encoder(RANKS, byte_bpe.code_point_classes())


def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.merger.ranks, special_tokens={})


LIBRARY = library()
ODD = [
    "", None, " ", "   ", "a", "it's I'M 'll'd 's's '''s x'st '' 're'ra", "a  b   c \n\n d\t e  ", "　x  y", "'", "a'", " 's", "\n's", "'ve'v'",
    "漢字かな한국어 👍🏽 1½Ⅷ", "a\x00b \x1c x\x85y", "<|endoftext|>", "x" * 5000, "ab" * 4000, "Ᲊ՘ \U00010d40",
]


def agree(texts):
    ids, offsets, first = ENCODER.encode(Texts(pa.array(texts, pa.string())))
    data, bounds = ENCODER.tokens.decode(ids, offsets, first)
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == LIBRARY.encode_ordinary(text or "")
        assert data[bounds[i] : bounds[i + 1]].tobytes() == (text or "").encode()


def test_odd_texts():
    agree(ODD)
    agree([t for t in ODD for _ in range(3)])
    agree([])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabst'''mdrevel   \n\t1½é漢👍! \u0085 "), max_size=60), max_size=30))
def test_slices_of_signs_and_spaces(texts):
    agree(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=10))
def test_any_text(texts):
    agree(texts)


def test_blocks_of_blocks(monkeypatch):
    draw = random.Random(5)
    text = "".join(draw.choice("ab's t're  \n12!'") for _ in range(20_000))
    for block in (2, 7, 512):
        monkeypatch.setattr(byte_bpe, "BLOCK", block)
        agree([text, "'s", text[::-1]])


def test_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_SLICES", 5)
    agree(["one two three four five six", "six seven eight"])
    agree(["seven eight nine ten", None])


def test_wrong_ids_stop():
    ids, offsets, first = ENCODER.encode(Texts(pa.array(["some words"])))
    with pytest.raises(ValueError):
        ENCODER.tokens.decode(np.full(1, 10**6, np.uint32), offsets[:1], np.array([0, 1]))
    with pytest.raises(ValueError):
        ENCODER.tokens.decode(ids, offsets + 1, first)


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    rows = QUERIES["op13_byte_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want


def test_defined_cases(spark):
    rows = [(1, None, "x", 5), (1, "", None, 6), (None, "a b", "y", 7), (None, "a b", "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `odd name` int")
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((r["odd name"], bytes(r["decoded"])) for r in back) == [(5, b""), (6, b""), (7, b"a b"), (7, b"a b")]
    assert back[0].asDict().keys() == {"doc_id", "text", "odd name", "ids", "offsets", "decoded"}
    assert byte_bpe.encode(docs.limit(0), RANKS).collect() == []
