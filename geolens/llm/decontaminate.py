"""Benchmark decontamination: normalised benchmark n-grams are broadcast, every window of every document is looked up.

An item gives its windows of ``window`` consecutive words (a shorter one, but not an empty one, is one window).
A scan task hashes all windows of a chunk of texts at once, looks the hashes up in a sorted array, and holds
each hit against the words themselves.  Documents are neither shuffled nor grouped.

The broadcast is bounded by ``windows_at_once``.  A larger benchmark is dealt into slices by hash; the documents
then pass once for each slice, written to the shared folder in between, and collect hits from all of them.

Defined cases: a null or empty text has no words and no hits; a null or empty item has no windows; a null item
id is the empty string; repeated items count once, repeated documents each for themselves; columns of the
documents named like a result column are replaced; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens.llm.words import ALNUM, Texts, Words, chunks, windows
from geolens.session import cut_lineage

WINDOW = 10
WINDOWS_AT_ONCE = 2_000_000

_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """(item, size, words, hash): each distinct window of each item; words are joined by one blank."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(part.column("text"))
                words = Words(texts, ALNUM, lower=True)
                hashes = words.hashes()
                rows = []
                for i, name in enumerate(part.column("item").to_pylist()):
                    a, b = words.first[i], words.first[i + 1]
                    size = min(window, b - a)
                    for p in range(a, b - size + 1) if size else ():
                        said = b" ".join(words.bytes[words.starts[k] : words.ends[k]].tobytes() for k in range(p, p + size))
                        rows.append((name, size, said.decode(), int(windows(hashes[p : p + size], size).view(np.int64)[0])))
                names, sizes, said, keys = zip(*rows) if rows else ((), (), (), ())
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int32()), pa.array(said, pa.string()), pa.array(keys, pa.int64())], ["item", "size", "words", "hash"])

    plain = benchmark.select(F.col(text).alias("text"), F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"))
    return plain.mapInArrow(cut, "item string, size int, words string, hash long").distinct()


def _hits(words: Words, i: int, spans: list[tuple[int, int]]) -> list[dict]:
    """Merged word ranges of text i, counted from its own first word, both ends included."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "last": b} for a, b in out]


def _without(whole: bytes, hits: list[dict], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each hit range; borders are those of its words."""
    begin, kept = 0, []
    for r in hits:
        kept.append(whole[begin : starts[r["first"]]])
        begin = ends[r["last"]]
    return b"".join([*kept, whole[begin:]]).decode()


def _scan(docs: DataFrame, rows: list, text: str, remove: bool = False) -> DataFrame:
    items: dict[str, list[str]] = {}
    hashes: dict[int, set[int]] = {}
    for r in rows:
        items.setdefault(r.words, []).append(r.item)
        hashes.setdefault(r.size, set()).add(r.hash)
    sorted_hashes = {size: np.sort(np.array(list(x), np.int64).view(np.uint64)) for size, x in hashes.items()}
    sent = docs.sparkSession.sparkContext.broadcast((items, sorted_hashes))
    names = docs.columns
    at = names.index(text)
    at_hits, at_items = names.index("hits"), names.index("items")
    keep = [i for i, n in enumerate(names) if n not in ("n_words", "hits", "items")]
    schema = ", ".join(f"`{names[i]}` {docs.schema[i].dataType.simpleString()}" for i in keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = sent.value
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in chunks(batch, f"c{at}"):
                texts = Texts(part.column(at))
                words = Words(texts, ALNUM, lower=True)
                hashes = words.hashes()
                owner = words.text_of_word()
                spans: dict[int, list[tuple[int, int]]] = {}
                found: dict[int, set[str]] = {}
                for size, keys in known.items():
                    key = windows(hashes, size)
                    if not len(key):
                        continue
                    hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                    hit &= owner[: len(key)] == owner[size - 1 :]
                    for p in np.flatnonzero(hit).tolist():
                        said = b" ".join(words.bytes[words.starts[k] : words.ends[k]].tobytes() for k in range(p, p + size))
                        for name in items.get(said.decode("utf-8", "replace"), ()):
                            i = int(owner[p])
                            a = p - int(words.first[i])
                            spans.setdefault(i, []).append((a, a + size - 1))
                            found.setdefault(i, set()).add(name)
                old_hits, old_items = part.column(at_hits).to_pylist(), part.column(at_items).to_pylist()
                for i, old in enumerate(old_hits):
                    if old:
                        spans.setdefault(i, []).extend((x["first"], x["last"]) for x in old)
                        found.setdefault(i, set()).update(old_items[i])
                n = len(texts)
                hits = [_hits(words, i, spans[i]) if i in spans else [] for i in range(n)]
                kept = {i: part.column(i) for i in keep}
                if remove and spans:
                    said = part.column(at).to_pylist()
                    for i in spans:
                        own = slice(words.first[i], words.first[i + 1])
                        said[i] = _without(texts.one(i), hits[i], words.starts[own] - texts.offsets[i], words.ends[own] - texts.offsets[i])
                    kept[at] = pa.array(said, pa.string())
                new = [
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(hits, _HITS),
                    pa.array([sorted(found[i]) if i in found else [] for i in range(n)], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*kept.values(), *new], names=[*(names[i] for i in keep), "n_words", "hits", "items"])

    return docs.mapInArrow(scan, f"{schema}, n_words long, hits array<struct<first: long, last: long>>, items array<string>")


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    windows_at_once: int = WINDOWS_AT_ONCE,
    remove: bool = False,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (merged word ranges inside windows) and ``items`` (ids of the items found).

    With ``remove`` the texts come without the hits, as from ``remove_hits``; ``n_words`` and ``hits`` are those before.
    """
    known = benchmark_windows(benchmark, window, item_text, item).persist()
    docs = docs.drop("n_words", "hits", "items").withColumn("hits", F.expr("cast(null as array<struct<first: long, last: long>>)"))
    docs = docs.withColumn("items", F.expr("cast(null as array<string>)"))
    try:
        slices = -(-known.count() // windows_at_once) or 1
        for b in range(slices):
            docs = _scan(docs, known.filter(F.pmod("hash", F.lit(slices)) == b).collect(), text, remove and b + 1 == slices)
            if b + 1 < slices:
                docs = cut_lineage(docs)
    finally:
        known.unpersist()
    return docs


def remove_hits(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``find_hits`` without the characters from the first to the last word of each hit range."""
    names = found.columns
    at, at_hits = names.index(text), names.index("hits")
    schema = found.schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in chunks(batch, f"c{at}"):
                texts = Texts(part.column(at))
                words = Words(texts, ALNUM, lower=True)
                hits = part.column(at_hits).to_pylist()
                out = part.column(at).to_pylist()
                for i, ranges in enumerate(hits):
                    if not ranges:
                        continue
                    own = slice(words.first[i], words.first[i + 1])
                    out[i] = _without(texts.one(i), ranges, words.starts[own] - texts.offsets[i], words.ends[own] - texts.offsets[i])
                arrays = [*part.columns]
                arrays[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return found.mapInArrow(remove, schema)


def drop_hit_documents(found: DataFrame) -> DataFrame:
    return found.filter(F.size("hits") == 0)
