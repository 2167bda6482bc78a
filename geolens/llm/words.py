"""Words of whole Arrow text columns as numpy arrays: the scan that most operators of this folder share.

A text column is one buffer of UTF-8 bytes with offsets.  Words are runs of bytes of a class, found for
all texts of a chunk at once; a word never crosses the end of its text.  Chunks hold a few MB of text
(or one longer text), so memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BYTE = np.arange(256)
#: Word bytes of ``[^\x20\x09-\x0D]+``: all but the six ASCII white space characters.
NOT_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case.
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)

_POSITIONS = 64
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _letter(code: np.ndarray) -> np.ndarray:
    return mix((code.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


_TABLE = _letter(np.arange(_POSITIONS * 256))


class Texts:
    """Bytes and offsets of one text (or binary) column; nulls are empty."""

    def __init__(self, column: pa.Array):
        binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        kind = pa.large_binary() if binary else pa.large_string()
        if column.type != kind:
            column = column.cast(kind)
        if column.null_count:
            column = column.fill_null(b"" if binary else "")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.data = whole[at[0] : at[-1]]
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def one(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """Word borders of all texts: ``first[i]`` to ``first[i + 1]`` are the words of text i."""

    def __init__(self, texts: Texts, table: np.ndarray, lower: bool):
        self.bytes = LOWER[texts.data] if lower else texts.data
        inside = table[self.bytes]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        cut = texts.offsets[:-1][texts.offsets[:-1] < len(inside)]
        starts[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = texts.offsets[1:][texts.offsets[1:] > 0] - 1
        ends[last] = inside[last]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, of its bytes and their places."""
        length = self.ends - self.starts
        at = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(at[-1]) - np.repeat(at[:-1], length)
        letters = self.bytes[self.inside]
        value = _TABLE[(np.minimum(place, _POSITIONS - 1) << 8) | letters]
        far = place >= _POSITIONS
        if far.any():
            value[far] = _letter((place[far] << 8) | letters[far])
        total = np.concatenate((np.zeros(1, _U), np.cumsum(value, dtype=_U)))
        return mix(total[at[1:]] - total[at[:-1]] + length.astype(_U))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word (runs over text ends included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    for i in range(size):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out)


def window_firsts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows that stay within their text, and their texts."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    at = np.concatenate(([0], np.cumsum(count)))
    return np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], count), np.repeat(np.arange(len(count)), count)


def give_back() -> None:
    """Hand freed memory back to the machine; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``size`` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    texts = Texts(batch.column(column))
    begin = 0
    while begin < n:
        end = int(np.searchsorted(texts.offsets, texts.offsets[begin] + size, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield batch.slice(begin, end - begin)
        begin = end
    give_back()
