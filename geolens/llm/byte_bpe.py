"""Byte-level BPE encoding and decoding of whole texts, with boundaries found by scans instead of regular expressions.

A chunk of texts becomes one array of code points and one array of their classes: letter, number, white space and
the rest.  Each code point is then a symbol of a small automaton; the look-aheads of the pattern (white space before
a word, the letters after an apostrophe) are comparisons of shifted arrays.  A symbol is a function from states to
states; these functions are closed under composition, so they are numbered and composed through a table.  Composition
is associative: rows of a block are composed side by side, then the blocks' results, and a last lookup gives the
state at each code point and with it the begin of each slice.  Nothing is sequential but the depth of a block.

Slices are Arrow slices of the chunk's bytes.  Distinct ones are looked up in a bounded cache; new ones are merged pair
by pair, lowest rank first, leftmost among equals (with a heap where a slice is long).  A token keeps the offset of its
first byte in the text; decoding writes each token's bytes at its offset, so any stretch of tokens can be decoded.

Nothing is shuffled.  Slices never cross texts; a cache that grows beyond its bound begins anew, which costs time only.

Defined cases: a null or empty text has no tokens and decodes to no bytes; repeated rows are encoded one by one;
columns named like a result column are replaced, other columns pass through; an empty table gives none.
An id outside the vocabulary, or offsets that don't fit their ids, stop the decoding with an error.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geolens.llm.words import Texts, chunks

CACHE_SLICES = 300_000
CACHE_IDS = 4_000_000
SHORT = 48  # bytes up to which a slice is merged without a heap
BLOCK = 512

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_SYMBOLS = ("letter", "number", "other", "inner", "prefix", "single", "quote1", "quote2")
_STATES = ("end", "letter", "number", "other", "inner", "prefix", "one", "two")


def code_point_classes() -> bytes:
    """Class of each code point by the Unicode tables of the tokenizer's own library, compressed.

    Found once on the driver: an encoding whose pattern is one class passes over everything else.
    """
    import tiktoken

    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = np.full(0x110000, _OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        only = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = only.decode_bytes(only.encode_ordinary("".join(letters))).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return zlib.compress(table.tobytes(), 9)


def _step(symbol: str, state: str) -> tuple[str, bool]:
    """Next state, and whether a slice begins at the symbol."""
    if symbol == "letter":
        if state in ("one", "two"):
            return ("end" if state == "one" else "one"), False
        return "letter", state not in ("letter", "prefix")
    if symbol in ("number", "other"):
        return symbol, state not in (symbol, "prefix")
    if symbol == "inner":
        return "inner", state != "inner"
    if symbol in ("prefix", "single"):
        return ("prefix" if symbol == "prefix" else "end"), True
    if state in ("other", "prefix"):  # an apostrophe inside or at the begin of a run of other signs
        return "other", False
    return ("one" if symbol == "quote1" else "two"), True


class Automaton:
    """Functions of the symbols, closed under composition, and tables to compose and apply them."""

    def __init__(self):
        n = len(_STATES)
        self.begins = np.zeros((2 * len(_SYMBOLS), n), bool)
        functions: dict[tuple[int, ...], int] = {}
        for k, symbol in enumerate(_SYMBOLS):
            steps = [_step(symbol, s) for s in _STATES]
            functions.setdefault(tuple(_STATES.index(s) for s, _ in steps), len(functions))
            self.begins[k] = [b for _, b in steps]
        firsts = [_STATES.index(_step(symbol, "end")[0]) for symbol in _SYMBOLS]
        for state in firsts:
            functions.setdefault((state,) * n, len(functions))
        self.begins[len(_SYMBOLS) :] = True  # the first symbol of a text
        of_symbol = [tuple(_STATES.index(_step(symbol, s)[0]) for s in _STATES) for symbol in _SYMBOLS] + [(s,) * n for s in firsts]
        todo = list(functions)
        while todo:
            f = todo.pop()
            for g in set(of_symbol):
                h = tuple(g[s] for s in f)
                if h not in functions:
                    functions[h] = len(functions)
                    todo.append(h)
        maps = np.array(list(functions))
        self.count = len(maps)
        self.apply = maps.astype(np.uint8).ravel()
        self.of_symbol = np.array([functions[f] for f in of_symbol], np.int16)
        place = {f: i for f, i in functions.items()}
        self.then = np.array([[place.get(tuple(g[f]), 0) for g in maps] for f in maps], np.int16).ravel()

    def prefixes(self, functions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Composition from each block's begin to each place, as (place in block, block), and from the begin to each block."""
        blocks = -(-len(functions) // BLOCK)
        padded = np.zeros(blocks * BLOCK, np.int16)
        padded[: len(functions)] = functions
        grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        for k in range(1, BLOCK):
            grid[k] = self.then[grid[k - 1].astype(np.int32) * self.count + grid[k]]
        before = np.full(blocks, -1, np.int16)
        if blocks > 1:
            inner, outer = self.prefixes(grid[-1, :-1])
            whole = inner.T.ravel()[: blocks - 1]
            known = np.repeat(outer, BLOCK)[: blocks - 1]
            before[1:] = np.where(known < 0, whole, self.then[np.maximum(known, 0).astype(np.int32) * self.count + whole])
        return grid, before

    def begins_at(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a slice begins at each symbol; symbols of a text's first code point are raised by their number."""
        if not len(symbols):
            return np.empty(0, bool)
        grid, before = self.prefixes(self.of_symbol[symbols])
        entry = np.where(before < 0, 0, self.apply[np.maximum(before, 0).astype(np.int32) * len(_STATES)])  # from state 0
        states = self.apply[grid.astype(np.int32) * len(_STATES) + entry].T.ravel()[: len(symbols)]
        return self.begins[symbols, np.concatenate(([0], states[:-1]))]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the places of their first bytes."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[places].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        lead, at = points[wide], places[wide]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            value[more] = (value[more] << 6) | (data[at[more] + k] & 0x3F)
        points[wide] = value
    return points, places


class Slicer:
    """Begins of the pattern's matches in all texts of a chunk."""

    def __init__(self, classes: bytes):
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.automaton = Automaton()

    def begins(self, texts: Texts) -> np.ndarray:
        points, places = code_points(texts.data)
        n = len(points)
        if not n:
            return np.empty(0, np.int64)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(places, texts.offsets)] = True  # the place after the last text included
        kind = self.classes[points]
        symbols = np.minimum(kind, _OTHER)
        space = kind == _SPACE
        symbols[space] = 3
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
        symbols[last] = np.where(points[last] == 0x20, 4, 5)
        quotes = np.flatnonzero((points[:-1] == 0x27) & ~first[1:-1])
        if len(quotes):
            after = points[quotes + 1]
            symbols[quotes[np.isin(after, [ord(c) for c in "stmd"])]] = 6
            quotes, after = quotes[quotes < n - 2], after[quotes < n - 2]
            then = np.where(first[quotes + 2], 0, points[quotes + 2])
            r, v, e, l = map(ord, "rvel")
            symbols[quotes[((after == r) | (after == v)) & (then == e) | (after == l) & (then == l)]] = 7
        symbols[first[:-1]] += len(_SYMBOLS)
        return places[self.automaton.begins_at(symbols)]


class Merger:
    """Pair merging by ranks with a bounded cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.joined: dict[tuple[int, int], int | None] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.at, self.ids = array("q", [0]), array("I")
        self.joined.clear()

    def _join(self, a: int, b: int) -> int | None:
        """The id of two neighbours as one token, which is also the rank of the pair."""
        key = a, b
        if key in self.joined:
            return self.joined[key]
        found = self.joined[key] = self.ranks.get(self.tokens[a] + self.tokens[b])
        return found

    def merge(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        none = len(self.tokens) + 1
        join = self._join
        ranks = [none if (r := join(a, b)) is None else r for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            ids[i : i + 2] = [least]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = none if (r := join(least, ids[i + 1])) is None else r
            if i:
                ranks[i - 1] = none if (r := join(ids[i - 1], least)) is None else r
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for a slice of n bytes."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self._join(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self._join(rank, ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := self._join(ids[h], rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [i for i in ids if i >= 0]

    def places(self, slices: list[bytes]) -> np.ndarray:
        """Numbers of slices in the cache; new ones are merged."""
        if len(self.place) > CACHE_SLICES or len(self.ids) > CACHE_IDS:
            self.clear()
        place, out = self.place, []
        for piece in slices:
            k = place.get(piece)
            if k is None:
                k = place[piece] = len(place)
                self.ids.extend(self.merge(piece))
                self.at.append(len(self.ids))
            out.append(k)
        return np.array(out, np.int64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Tokens:
    """Bytes of all ids in one array."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens) + 1
        self.size = np.full(size, -1, np.int64)
        for i, token in tokens.items():
            self.size[i] = len(token)
        self.begin = np.concatenate(([0], np.cumsum(np.maximum(self.size, 0))))
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, each token at its offset, and the first byte of each text."""
        if len(ids) and (ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = ends[first]
        if len(offsets) != len(ids) or not np.array_equal(np.repeat(bounds[:-1], np.diff(first)) + offsets, ends[:-1]):
            raise ValueError("the offsets don't belong to the ids")
        return self.bytes[_ranges(self.begin[ids], size)], bounds


class Encoder:
    def __init__(self, path: str, classes: bytes):
        self.slicer, self.merger = Slicer(classes), Merger(path)
        self.tokens = Tokens(self.merger.tokens)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the offset of each in its text, and the first token of each text."""
        begins = self.slicer.begins(texts)
        if not len(begins):
            return np.empty(0, "<u4"), np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        bounds = np.append(begins, len(texts.data)).astype(np.int64)
        data = np.ascontiguousarray(texts.data)
        slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = slices.dictionary_encode()
        own = self.merger.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        at, pool = np.frombuffer(self.merger.at, np.int64), np.frombuffer(self.merger.ids, np.uint32)
        size = at[own + 1] - at[own]
        ids = pool[_ranges(at[own], size)].astype("<u4", copy=False)
        length = self.tokens.size[ids]
        first = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(begins, texts.offsets)]
        offsets = np.cumsum(length) - length - np.repeat(texts.offsets[:-1], np.diff(first))
        return ids, offsets.astype("<u4"), first


_ENCODERS: dict[str, Encoder] = {}
_TOKENS: dict[str, Tokens] = {}


def _encoder(path: str, classes: bytes) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, classes)
    return _ENCODERS[path]


def _tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(Merger(path).tokens)
    return _TOKENS[path]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _mapped(df: DataFrame, names: list[str], used: list[str], out: list[str], kind: str, work) -> DataFrame:
    """The columns ``names`` with the binary columns ``out`` that ``work`` gives for ``used``."""
    plain = df.select(*dict.fromkeys([*names, *used]))
    at = [plain.columns.index(u) for u in used]
    schema = ", ".join([*(f"`{n}` {plain.schema[n].dataType.simpleString()}" for n in names), *(f"`{o}` {kind}" for o in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, more in work(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), at):
                yield pa.RecordBatch.from_arrays([*columns[: len(names)], *more], names=[*names, *out])

    return plain.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, text: str = "text", passing: list[str] | None = None) -> DataFrame:
    """The columns ``passing`` (default: all) with ``ids`` and ``offsets``, both little-endian unsigned 32-bit integers."""
    classes = code_point_classes()
    names = [c for c in passing or docs.columns if c not in ("ids", "offsets")]

    def work(batch: pa.RecordBatch, at: list[int]):
        encoder = _encoder(ranks, classes)
        for part in chunks(batch, f"c{at[0]}"):
            ids, offsets, first = encoder.encode(Texts(part.column(at[0])))
            yield part.columns, [_binary(ids, 4 * first), _binary(offsets, 4 * first)]

    return _mapped(docs, names, [text], ["ids", "offsets"], "binary", work)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", offsets: str = "offsets", passing: list[str] | None = None) -> DataFrame:
    """The columns ``passing`` (default: all) with ``decoded``: the bytes the ids stand for."""
    names = [c for c in passing or encoded.columns if c != "decoded"]

    def work(batch: pa.RecordBatch, at: list[int]):
        tokens = _tokens(ranks)
        for part in chunks(batch, f"c{at[0]}"):
            own, places = Texts(part.column(at[0])), Texts(part.column(at[1]))
            yield part.columns, [_binary(*tokens.decode(own.data.view("<u4"), places.data.view("<u4"), own.offsets // 4))]

    return _mapped(encoded, names, [ids, offsets], ["decoded"], "binary", work)
