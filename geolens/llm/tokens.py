"""Token ids of whole texts by a public tokenizer, with a bounded memo of white-space separated chunks.

White space never lies within a token of the tokenizers used here, so a text's ids are its chunks' ids in order.
Chunks of ASCII and Latin letters are cut into pre-tokens by array operations over all texts at once.  Only distinct
pre-tokens are looked up; those that a worker has not met are merged by the tokenizer's own model, many in one
call.  Every other chunk goes through the complete tokenizer.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from geolens.llm.byte_bpe import _SYMBOLS, Automaton
from geolens.llm.words import LOWER, NOT_SPACE, Texts, Words

MEMO = 700_000

_CONTROL = frozenset([*range(33), 127])
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_SINGLE = _SYMBOLS.index("single")


def _byte_classes() -> np.ndarray:
    """Classes of single bytes; the bytes above ASCII are odd until their pair is known."""
    out = np.full(256, _ODD, np.uint8)
    out[33:127] = _OTHER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("a") : ord("z") + 1] = _LETTER
    out[~NOT_SPACE] = _SPACE
    return out


_CLASSES = _byte_classes()


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable bytes stand for themselves, the others for letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = {code: "".join(_byte_letters()[b] for b in chr(code).encode()) for code in range(0xC0, 0x100)}


class WordEndTokenizer:
    """Ids of a BPE tokenizer with a word-end suffix whose pre-tokens are letters, single digits or other signs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self._whole = path, None
        parts = json.loads(open(path, encoding="utf-8").read())
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merger = Tokenizer.from_str(json.dumps(parts))
        vocabulary = parts["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = parts["model"]["end_of_word_suffix"]
        self.ends[[i for s, i in vocabulary.items() if s.endswith(suffix)]] = True
        self.automaton = Automaton()
        self.clear()

    def clear(self) -> None:
        """Forget all chunks: numbers of chunks, and their ids one after the other."""
        self.place: dict[bytes, int] = {}
        self.at, self.ids = array("q", [0]), array("I")

    @property
    def whole(self):
        """The complete tokenizer, loaded when the first chunk asks for it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _slow(self, chunk: str) -> bytes:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Units and their ids; ASCII ones are their own byte-level letters."""
        ascii_, latin = [], []
        for raw in missing:
            if b"<|" not in raw:
                if raw.isascii() and _CONTROL.isdisjoint(raw):
                    ascii_.append(raw)
                    continue
                if _PLAIN.fullmatch(raw.decode()):
                    latin.append(raw)
                    continue
            yield raw, self._slow(raw.decode())
        for group in (ascii_, latin):
            if not group:
                continue
            said = b" ".join(group).decode()
            ids = np.array(self.merger.encode(said if group is ascii_ else said.translate(_LETTERS), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(group):
                raise ValueError(f"{len(group)} pre-tokens gave {len(ends)} word ends")
            data = ids.tobytes()
            yield from ((raw, data[4 * a : 4 * b]) for raw, a, b in zip(group, [0, *ends], ends, strict=False))

    def places(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of units; those not met before are learnt."""
        if len(self.place) > MEMO:
            self.clear()
        found = list(map(self.place.get, distinct))
        missing = [i for i, k in enumerate(found) if k is None]
        if missing:
            place, n = self.place, len(self.place)
            new: list[bytes] = []
            for raw, ids in self._learn([distinct[i] for i in missing]):
                place[raw] = n
                n += 1
                new.append(ids)
            ends = np.cumsum([len(x) // 4 for x in new]) + len(self.ids)
            self.ids.frombytes(b"".join(new))
            self.at.extend(ends.tolist())
            for i in missing:
                found[i] = place[distinct[i]]
        return np.array(found, np.int64)

    def units(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all units, where each begins in them (and the end), and the first unit of each text.

        Units of a white-space separated chunk of plain letters are its pre-tokens in lower case; any other chunk is
        one unit as it stands.
        """
        data = texts.data
        n = len(data)
        words = Words(texts, NOT_SPACE, lower=False)
        lower = LOWER[data]
        kind = _CLASSES[lower]
        pair = np.flatnonzero(data[:-1] == 0xC3)
        second = data[pair + 1]
        latin = (second != 0x97) & (second != 0xB7)
        pair, second = pair[latin], second[latin]
        kind[pair] = kind[pair + 1] = _LETTER
        lower[pair + 1] = np.where(second <= 0x9E, second + 0x20, second)
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        kind[marks] = _ODD
        odd = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(kind == _ODD)))[np.stack((words.starts, words.ends))], axis=0)[0])
        symbols = np.array([_SINGLE, 0, _SINGLE, 2, 2], np.uint8)[kind]
        quotes = np.flatnonzero(data[: n - 1] == ord("'"))
        if len(quotes):
            after = lower[quotes + 1]
            symbols[quotes[np.isin(after, np.frombuffer(b"stmd", np.uint8))]] = 6
            then = np.where(quotes + 2 < n, lower[np.minimum(quotes + 2, n - 1)], 0)
            r, v, e, l = b"rvel"
            symbols[quotes[((after == r) | (after == v)) & (then == e) | (after == l) & (then == l)]] = 7
        symbols[words.starts] += len(_SYMBOLS)
        begins = self.automaton.begins_at(symbols)
        begins &= words.inside
        if len(odd):
            inside = np.zeros(n + 1, np.int8)
            inside[words.starts[odd]] = 1
            inside[words.ends[odd]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            begins &= ~inside
            begins[words.starts[odd]] = True
            lower[inside] = data[inside]
        at = np.flatnonzero(begins)
        letters = np.ascontiguousarray(lower[words.inside])
        bounds = np.append((np.cumsum(words.inside) - 1)[at], len(letters)).astype(np.int64)
        return letters, bounds, np.searchsorted(at, texts.offsets)

    def encode(self, texts: Texts) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not len(texts.data):
            return [b""] * len(texts)
        letters, bounds, first = self.units(texts)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        own = self.places(units.dictionary.to_pylist())[units.indices.to_numpy()]
        at = np.frombuffer(self.at, np.int64).astype(np.int32)  # the memo is far below 2^31 ids
        size = np.diff(at)[own]
        ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)))
        ids = np.frombuffer(self.ids, np.uint32)[np.arange(ends[-1], dtype=np.int32) + np.repeat(at[own] - ends[:-1], size)].astype("<u4", copy=False)
        data, cut = ids.tobytes(), (4 * ends[first].astype(np.int64)).tolist()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_LOADED: dict[str, WordEndTokenizer] = {}


def loaded(path: str) -> WordEndTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordEndTokenizer(path)
    return _LOADED[path]


def token_bytes(column: pa.Array, path: str) -> list[bytes]:
    return loaded(path).encode(Texts(column))
