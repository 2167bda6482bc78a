"""Periodic runs of words by maximal pairs on a bottom-up tree of LCP intervals.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least ``least`` words and
two periods.  If it begins at i and has length n, the suffixes at i and i + q agree on exactly n - q words and differ
in the word before them: they are a maximal pair at distance q.  Conversely a maximal pair (i, j) that agrees on
l >= j - i words is such a stretch with period j - i, so nothing has to be extended to either side; of the pairs of one
stretch the smallest distance is its smallest period.  As l >= q and l + q >= least, only LCP intervals of at least
``least / 2`` words matter.

* Words of a chunk of texts get numbers, another set for each text, so nothing crosses texts.  Suffixes are sorted by
  prefix doubling; a suffix whose first words are unique is final and leaves the sorting, so on ordinary prose hardly
  any are left after the third round.
* Agreements of neighbours in the sorted order are found for suffixes whose predecessor isn't a neighbour's
  predecessor too; all others are one less than the one before them.
* The tree is walked bottom-up with a stack.  An interval keeps the places of its suffixes in text order, each with
  its class: the word to its left.  When intervals join, the places of the smaller one are put into the larger one.
  A place pairs with its nearest neighbour on either side, if that one came from another child and has another
  class.  Nearest ones are enough: a third occurrence between i and j would give the agreed words two periods with
  sum j - i, hence (Fine and Wilf) their common divisor as a period, and the pair wouldn't be at the smallest period.
* Intervals whose suffixes are all farther apart than the words they agree on are never walked.

A place is put into a larger set log n times at most, and pairs are at most two for each time: no pairs of a
class or group are listed.  Nothing is shuffled.

Defined cases: null, empty and white-space texts have no words and no runs; of runs with equal length the one with the
smallest start, then period is the longest; repeated rows are searched one by one; columns named like a result column
are replaced, other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolens.llm.words import NOT_SPACE, Texts, Words, chunks

LEAST = 12
_STEP = 16
_FEW = 16  # a set so many times smaller than the other is put into it place by place

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(texts: Texts) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, a number for each (other ones in each text, and one of its own at each text's end), and the texts' begins."""
    words = Words(texts, NOT_SPACE, lower=False)
    length = words.ends - words.starts
    letters = np.ascontiguousarray(texts.data[words.inside])
    bounds = np.concatenate(([0], np.cumsum(length)))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    distinct = len(coded.dictionary) + 1
    owner = words.text_of_word()
    numbers = np.arange(1, len(texts) + 1)
    numbers = np.repeat(numbers * distinct - 1, 1 + np.diff(words.first))
    numbers[np.arange(len(owner)) + owner] = owner * distinct + coded.indices.to_numpy()
    return words, numbers, words.first[:-1] + np.arange(len(texts))


def _shared(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The places whose group has a second one."""
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    return order[same[1:] | same[:-1]]


def _groups(keys: np.ndarray) -> np.ndarray:
    """For each place of sorted keys the first place with the same key."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def sorted_suffixes(numbers: np.ndarray, least: int) -> np.ndarray:
    """Sorted suffixes that may agree with another one on ``least`` words; all that do are among them."""
    n, size, repeated = len(numbers), 1, None
    open_ = np.argsort(numbers, kind="stable")
    group = _groups(numbers[open_])
    rank = np.empty(n, np.int64)
    rank[open_] = group
    open_ = _shared(open_, group)
    while True:
        if repeated is None and 2 * size > least:
            repeated = open_
        if not len(open_):
            break
        key = rank[open_] * n + rank[open_ + size]  # an open suffix has no text's end in its first words
        inner = np.argsort(key, kind="stable")
        open_, key = open_[inner], key[inner]
        old = rank[open_]
        group = old + _groups(key) - _groups(old)
        rank[open_] = group
        open_ = _shared(open_, group)
        size *= 2
    if repeated is None:
        return np.empty(0, np.int64)
    return repeated[np.argsort(rank[repeated], kind="stable")]


def _agreements(numbers: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words on which two suffixes agree, pair by pair."""
    out, open_, at = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    ahead, last = np.arange(_STEP), len(numbers) - 1
    while len(open_):
        differ = numbers[np.minimum(a[open_, None] + at + ahead, last)] != numbers[np.minimum(b[open_, None] + at + ahead, last)]
        found = differ.any(axis=1)
        out[open_[found]] = at + differ[found].argmax(axis=1)
        open_, at = open_[~found], at + _STEP
    return out


def neighbour_agreements(numbers: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Words on which each sorted suffix agrees with the one before it (the first with none)."""
    if not len(suffixes):
        return np.empty(0, np.int64)
    by_place = np.argsort(suffixes, kind="stable")
    place = suffixes[by_place]
    before = np.concatenate(([-1], suffixes[:-1]))[by_place]
    goes_on = np.zeros(len(place), bool)
    goes_on[1:] = (place[1:] == place[:-1] + 1) & (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    goes_on &= numbers[place - 1] == numbers[np.maximum(before, 1) - 1]
    heads = np.flatnonzero(~goes_on)
    known = before[heads] >= 0
    agree = np.zeros(len(heads), np.int64)
    agree[known] = _agreements(numbers, place[heads[known]], before[heads[known]])
    own = np.cumsum(~goes_on) - 1
    out = np.empty(len(place), np.int64)
    out[by_place] = agree[own] - (place - place[heads[own]])
    return out


def _walkable(suffixes: np.ndarray, agree: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of the sorted suffixes that are an interval of ``least`` words and hold two close enough places."""
    joined = agree >= least
    starts = np.flatnonzero(joined & ~np.concatenate(([False], joined[:-1]))) - 1
    ends = np.flatnonzero(joined & ~np.concatenate((joined[1:], [False]))) + 1
    if not len(starts):
        return []
    inside = np.zeros(len(suffixes) + 1, np.int64)
    inside[starts] += 1
    inside[ends] -= 1
    used = np.flatnonzero(np.cumsum(inside[:-1]))
    tree = np.searchsorted(starts, used, side="right") - 1
    order = np.lexsort((suffixes[used], tree))
    place = suffixes[used[order]]
    gap = np.full(len(place), np.iinfo(np.int64).max)
    same = tree[order][1:] == tree[order][:-1]
    gap[1:][same] = np.diff(place)[same]
    first = np.searchsorted(tree, np.arange(len(starts)))
    deep = agree[used].copy()
    deep[first] = 0
    close = np.minimum.reduceat(gap, first) <= np.maximum.reduceat(deep, first)
    return list(zip(starts[close].tolist(), ends[close].tolist(), strict=True))


def maximal_pairs(numbers: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period; places are those of ``numbers``."""
    words = -(-least // 2)
    suffixes = sorted_suffixes(numbers, words)
    agree = neighbour_agreements(numbers, suffixes)
    found: list[tuple[int, int, int]] = []

    def pair(i: int, j: int, deep: int) -> None:
        gap = j - i
        if gap <= deep and gap + deep >= least and (i == 0 or numbers[i - 1] != numbers[j - 1]):
            found.append((i, gap + deep, gap))

    def join(a: list[int], b: list[int], deep: int) -> list[int]:
        """Places of two children of an interval together; pairs between them are found."""
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect_left(a, x)
            if k:
                pair(a[k - 1], x, deep)
            if k < len(a):
                pair(x, a[k], deep)
        if len(b) * _FEW < len(a):
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()
        return a

    for begin, end in _walkable(suffixes, agree, words):
        places, depth = suffixes[begin:end].tolist(), agree[begin:end].tolist()
        stack: list[tuple[int, list[int]]] = []
        child = [places[0]]
        for place, deep in zip(places[1:], depth[1:], strict=True):
            while stack and stack[-1][0] >= deep:
                below, others = stack.pop()
                child = join(others, child, below)
            stack.append((deep, child))
            child = [place]
        while stack:
            below, others = stack.pop()
            child = join(others, child, below)
    runs = np.array(found, np.int64).reshape(-1, 3)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    kept = np.ones(len(runs), bool)
    kept[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # of one stretch the smallest distance
    runs = runs[kept]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapsed(texts: Texts, words: Words, drop: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    kept = np.flatnonzero(~drop)
    size = words.ends[kept] - words.starts[kept] + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.starts[kept] - (ends - size), size)
    data = texts.data[np.minimum(at, len(texts.data) - 1)] if len(at) else np.empty(0, np.uint8)
    data[ends - 1] = 0x20
    first = np.searchsorted(kept, words.first)
    last = np.zeros(len(data), bool)
    last[np.concatenate(([0], ends))[first[1:][np.diff(first) > 0]] - 1] = True  # no space after a text's last word
    bounds = np.concatenate(([0], ends))[first] - np.concatenate(([0], np.cumsum(np.diff(first) > 0)))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data[~last])))


def search(texts: Texts, least: int = LEAST) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    words, numbers, begins = numbered(texts)
    runs = maximal_pairs(numbers, least)
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    cover = np.zeros(len(words.starts) + 1, np.int64)
    at = runs[:, 0] - owner  # places of words without the texts' ends
    np.add.at(cover, at + runs[:, 2], 1)
    np.add.at(cover, at + runs[:, 1], -1)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    fields = [pa.array(runs[:, 0] - begins[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
    listed = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return listed, _collapsed(texts, words, np.cumsum(cover[:-1]) > 0).cast(pa.string())


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, passing: list[str] | None = None) -> DataFrame:
    """The columns ``passing`` (default: all) with ``runs`` (by start, then period) and ``collapsed``.

    ``runs`` counts words from 0; ``collapsed`` is the text's words without those that a run contains after its
    first period, joined by one space.
    """
    names = [c for c in passing or docs.columns if c not in ("runs", "collapsed")]
    plain = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col(f"`{text}`").alias("text"))
    schema = ", ".join([*(f"c{i} {plain.schema[i].dataType.simpleString()}" for i in range(len(names))), f"runs {RUNS}", "collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = search(Texts(part.column("text")), least)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=[*part.schema.names[:-1], "runs", "collapsed"])

    return plain.mapInArrow(run, schema).toDF(*names, "runs", "collapsed")


def longest(runs: str = "runs") -> Column:
    """The longest run of the column; of equal lengths the one with the smallest start, then period."""
    worth = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(worth)
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
