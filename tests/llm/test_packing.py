import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from geolens.llm import packing
from geolens.llm.queries import QUERIES, vocabulary
from geolens.llm.tokens import WordEndTokenizer
from geolens.llm.words import Texts

FOLDER = "/root/testdata/sf0.001"
PATH = vocabulary("word_bpe_49k.json")
ODD = [
    "", "  \n", "it's I'M don't'll we'd '''s x'st", "<|endoftext|> a<|endoftext|>b", "İstanbul ÀÉ éé Straße ß÷×µªº 12345 ½ ①", "é áb ́x café",
    "a\x00b \x1c x\x85y z w v 漢字かな한국어 👍🏽 ſ K Å Ω", "ﬁ ǅ ΣΑΣ ΑΣ. ÅÅ", "A" * 5000, "!!!###$$ <a href='x'>T's</a>", "x¶y 'S 'T ÿ Ÿ", None,
]


def own_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_the_tokenizer_s(spark, monkeypatch):
    whole = Tokenizer.from_file(PATH)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for memo in (400_000, 50):
        monkeypatch.setattr("geolens.llm.tokens.MEMO", memo)
        mine = WordEndTokenizer(PATH)
        got = [b for k in range(0, len(texts), 7) for b in mine.encode(Texts(pa.array(texts[k : k + 7], pa.string())))]
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == want


def check_placed(rows, length):
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(fill)


def test_query(spark):
    docs = {r["doc_id"]: own_ids(r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op7_best_fit_packing"](spark, FOLDER).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for k, ids in docs.items():
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[k, p] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert got == want
    used = check_placed(rows, 4096)
    assert used == packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=4097))


@pytest.mark.parametrize("seed", range(6))
def test_bound_and_packing_against_the_optimum(seed):
    """All partitions of a few pieces into sequences."""
    rng = np.random.default_rng(seed)
    for _ in range(30):
        length = int(rng.integers(6, 20))
        sizes = np.sort(rng.integers(1, length + 1, int(rng.integers(1, 7))))[::-1]
        best = len(sizes)
        for plan in itertools.product(range(len(sizes)), repeat=len(sizes)):
            loads = np.bincount(plan, weights=sizes)
            if loads.max() <= length:
                best = min(best, len(set(plan)))
        bound = packing.lower_bound(np.bincount(sizes, minlength=length + 1), length)
        bins, offsets, fill = packing.best_fit_decreasing(sizes, length)
        assert bound <= best <= len(fill) and fill.max() <= length
        assert sorted(np.bincount(bins, weights=sizes)) == sorted(fill)


@pytest.mark.parametrize("rows_per_bucket", [20, 100, 10_000])
def test_rounds_of_exchange(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    sizes = np.concatenate((rng.integers(1, 60, 500), rng.integers(40, 101, 200), np.full(30, 100)))
    frame = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "row long, length long")
    from geolens.session import cut_lineage

    placed = packing.place(cut_lineage(frame), 100, rows_per_bucket)
    rows = placed.join(frame, "row").collect()
    assert sorted(r["row"] for r in rows) == list(range(len(sizes)))
    # a certified bucket wastes less than one sequence
    buckets = -(-len(sizes) // rows_per_bucket)
    assert check_placed(rows, 100) <= packing.lower_bound(np.bincount(sizes, minlength=101), 100) + buckets


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "b"), (None, "", "c"), (3, "word " * 9000, "d"), (3, "word " * 9000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs, PATH, with_ids=True).collect()
    assert check_placed(got, 4096) == 5
    assert sorted((repr(r["doc_id"]), r["piece"], r["length"], len(r["ids"])) for r in got) == sorted(
        [("1", 0, 1, 1)] * 2 + [("None", 0, 1, 1)] + [("3", 0, 4096, 4096), ("3", 1, 4096, 4096), ("3", 2, 809, 809)] * 2
    )
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_groups_stay_bounded_where_most_pieces_come_back(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1025, 2048, 4000)
    dealt, pack = [], packing._pack

    def watched(open_, buckets, *rest, **more):
        dealt.append((open_.count(), buckets))
        return pack(open_, buckets, *rest, **more)

    monkeypatch.setattr(packing, "_pack", watched)
    written = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "row long, length long")
    rows = packing.place(written, rows_per_bucket=250).join(written, "row").collect()
    assert len(rows) == len(sizes) and len(dealt) > 1
    assert all(buckets == -(-n // 250) for n, buckets in dealt)
    used = check_placed(rows, 4096)
    alone = len(packing.best_fit_decreasing(np.sort(sizes)[::-1])[2])
    assert used <= 1.02 * alone
    assert len({r["sequence_id"] for r in rows}) == used


def test_too_many_sequences_in_a_bucket_stop(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS", 3)
    written = spark.createDataFrame([(i, 3000) for i in range(10)], "row long, length long")
    with pytest.raises(Exception, match="use fewer rows"):
        packing.place(written).collect()
