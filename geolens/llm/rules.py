"""Quality rules: counting rules, then the distance of a document's letters and common words from its language.

Pass one counts, over every document that the counting rules accept, characters by class and words by
language; the most frequent words of a language, of any length and script, are its common words.  Pass two compares the two
histograms of each document with those of its language by Jensen-Shannon distance (base 2, 0 to 1).  Counts are
integers, so a verdict does not depend on how rows are dealt out.

Words are counted by 64-bit hashes of their bytes, A-Z lower case.  A verdict could only change if a word shared its hash
with one of the few common words: of a thousand million different words, one does with a chance of 4 in 10^9 a language.

Only counts by (language, class or word) are shuffled, added up inside the tasks first.  The references are
``common_words`` + 9 numbers a language; they are sent along with the tasks for at most ``languages_at_once``
languages, and more languages are scored in that many passes over the documents.

Defined cases: a null or empty text has no words and fails the rules; a null language is a language of its own;
a text below the minimum lengths, or of a language with little text, is not judged by distance; repeated rows
are judged one by one; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolens.llm.words import LOWER, NOT_SPACE, Texts, Words, chunks, window_firsts, windows

CLASSES = 9


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_window: int = 5
    max_repeat_percent: int = 20
    common_words: int = 64
    min_chars: int = 300  # for the distance of classes
    min_judged_words: int = 50  # for the distance of words
    min_reference_words: int = 5000
    max_class_distance: float = 0.33
    max_word_distance: float = 0.52
    languages_at_once: int = 1000


def _classes() -> np.ndarray:
    """Class of the character that begins with a byte; 9 marks bytes within a character."""
    out = np.full(256, 6)
    for byte in range(256):
        c = chr(byte)
        if 0x80 <= byte < 0xC0:
            out[byte] = CLASSES
        elif byte >= 0xC0:
            out[byte] = 4
        elif c.islower():
            out[byte] = 0
        elif c.isupper():
            out[byte] = 1
        elif c.isdigit():
            out[byte] = 2
        elif c == "\n":
            out[byte] = 8
        elif not NOT_SPACE[byte]:
            out[byte] = 3
        elif c in "#*$%&|<>":
            out[byte] = 5
        elif c in ".,;:!?'\"()-":
            out[byte] = 7
    return out


_CLASS = _classes()
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


class _Scan:
    """All counts of the texts of one chunk."""

    def __init__(self, texts: Texts, rules: Rules):
        data, offsets = texts.data, texts.offsets
        self.words = words = Words(texts, NOT_SPACE, lower=False)
        self.n = len(texts)
        self.n_words = np.diff(words.first)
        self.word_chars = _per_text(NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
        self.n_symbols = _per_text(_SYMBOL[data], offsets)
        self.n_dup_lines = np.zeros(self.n, np.int64)
        for i in np.flatnonzero(_per_text(data == 10, offsets)):
            lines = [x for x in texts.one(i).split(b"\n") if x.strip()]
            self.n_dup_lines[i] = len(lines) - len(set(lines))
        self.n_repeat_words = self._repeats(rules.repeat_window)
        self.failed = (self.n_words < rules.min_words) | (100 * self.n_repeat_words > rules.max_repeat_percent * self.n_words)

    def _repeats(self, size: int) -> np.ndarray:
        first, owner = window_firsts(self.words.first, size)
        if not len(first):
            return np.zeros(self.n, np.int64)
        key = windows(self.words.hashes(), size)[first]
        order = np.lexsort((key, owner))
        same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        found = np.zeros(len(order), bool)
        found[1:] |= same
        found[:-1] |= same
        at = first[order[found]]
        change = np.zeros(len(self.words.starts) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        return _per_text(np.cumsum(change)[:-1] > 0, self.words.first)

    def class_counts(self, texts: Texts) -> np.ndarray:
        owner = np.repeat(np.arange(self.n), np.diff(texts.offsets))
        code = owner * (CLASSES + 1) + _CLASS[texts.data]
        return np.bincount(code, minlength=self.n * (CLASSES + 1)).reshape(self.n, CLASSES + 1)[:, :CLASSES]

    def word_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, A-Z lower case, and their texts."""
        low = copy(self.words)
        low.bytes = LOWER[self.words.bytes]
        return low.hashes().view(np.int64), self.words.text_of_word()


def _languages(column: pa.Array) -> tuple[list[str | None], np.ndarray]:
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
    return [*names, None], codes


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, key, n): characters by class, all words (kind ``all``), and the common words by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}

        def rows():
            lang, kind, key, n = zip(*((*k, v) for k, v in found.items()))
            return pa.record_batch([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["lang", "kind", "key", "n"])

        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(part.column("text"))
                scan = _Scan(texts, rules)
                names, code = _languages(part.column("lang"))
                good = ~scan.failed
                by_class = scan.class_counts(texts)
                keys, owner = scan.word_keys()
                for c, name in enumerate(names):
                    rows_of = good & (code == c)
                    if not rows_of.any():
                        continue
                    for k, v in enumerate(by_class[rows_of].sum(axis=0)):
                        found[name, "class", k] = found.get((name, "class", k), 0) + int(v)
                    key, n = np.unique(keys[rows_of[owner]], return_counts=True)
                    for k, v in zip(key.tolist(), n.tolist()):
                        found[name, "word", k] = found.get((name, "word", k), 0) + v
                    k = (name, "all", 0)
                    found[k] = found.get(k, 0) + int(scan.n_words[rows_of].sum())
                if len(found) > 500_000:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    counts = (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .mapInArrow(count, "lang string, kind string, key long, n long")
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= max(rules.common_words, CLASSES)).drop("rank")


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` (counts) to ``q`` (counts)."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


class _Reference:
    def __init__(self, rows: list, rules: Rules):
        self.classes = np.zeros(CLASSES, np.int64)
        words, self.n_words = {}, 0
        for r in rows:
            if r.kind == "class":
                self.classes[r.key] = r.n
            elif r.kind == "word":
                words[r.key] = r.n
            else:
                self.n_words = r.n
        self.keys = np.array(sorted(words), np.int64)
        common = np.array([words[k] for k in sorted(words)], np.int64)
        self.words = np.append(common, self.n_words - common.sum())
        self.enough = self.n_words >= rules.min_reference_words and len(self.keys) > 0


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _judge(docs: DataFrame, rows: list, rules: Rules, text: str, lang: str) -> DataFrame:
    by_lang: dict[str | None, list] = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    known = {k: _Reference(v, rules) for k, v in by_lang.items()}
    schema = docs.schema
    names = [f.name for f in schema]
    at_text, at_lang = names.index(text), names.index(lang)
    declared = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, schema))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in chunks(batch, f"c{at_text}"):
                texts = Texts(part.column(at_text))
                scan = _Scan(texts, rules)
                langs, code = _languages(part.column(at_lang))
                class_distance = np.full(len(texts), np.nan)
                word_distance = np.full(len(texts), np.nan)
                by_class, (keys, owner) = scan.class_counts(texts), scan.word_keys()
                long_enough = by_class.sum(axis=1) >= rules.min_chars
                wordy = scan.n_words >= rules.min_judged_words
                for c, name in enumerate(langs):
                    ref = known.get(name)
                    if ref is None or not ref.enough:
                        continue
                    mine = code == c
                    rows_ = np.flatnonzero(mine & long_enough)
                    class_distance[rows_] = js_distance(by_class[rows_], ref.classes)
                    rows_ = np.flatnonzero(mine & wordy)
                    if not len(rows_):
                        continue
                    place = np.full(len(texts), -1)
                    place[rows_] = np.arange(len(rows_))
                    spot = np.minimum(np.searchsorted(ref.keys, keys), len(ref.keys) - 1)
                    hit = (ref.keys[spot] == keys) & (place[owner] >= 0)
                    width = len(ref.words)
                    counts = np.bincount(place[owner[hit]] * width + spot[hit], minlength=len(rows_) * width).reshape(-1, width)
                    counts[:, -1] = scan.n_words[rows_] - counts.sum(axis=1)
                    word_distance[rows_] = js_distance(counts, ref.words)
                far = (class_distance > rules.max_class_distance) | (word_distance > rules.max_word_distance)
                new = [scan.n_words, scan.word_chars, scan.n_symbols, scan.n_dup_lines, scan.n_repeat_words, scan.failed]
                arrays = [pa.array(x) for x in new]
                arrays += [pa.array(x, mask=np.isnan(x)) for x in (class_distance, word_distance)]
                arrays.append(pa.array(~scan.failed & ~far))
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*names, *_NAMES])

    return docs.mapInArrow(judge, f"{declared}, {_COLUMNS}")


def quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", passing: list[str] | None = None) -> DataFrame:
    """The columns ``passing`` (default: all) of each document with its counts, distances and verdict ``kept``.

    Columns of ``docs`` named like a result column are left out.
    """
    docs = docs.select(*dict.fromkeys([*(c for c in passing or docs.columns if c not in _NAMES), text, lang]))
    refs = references(docs, rules, text, lang).persist()
    try:
        slices = -(-refs.select("lang").distinct().count() // rules.languages_at_once) or 1
        part = F.pmod(F.xxhash64("lang"), F.lit(slices))
        parts = [refs.filter(part == b).collect() for b in range(slices)]
    finally:
        refs.unpersist()
    out = None
    for b, rows in enumerate(parts):
        mine = docs if slices == 1 else docs.filter(F.pmod(F.xxhash64(F.col(lang)), F.lit(slices)) == b)
        judged = _judge(mine, rows, rules, text, lang)
        out = judged if out is None else out.unionByName(judged)
    return out
