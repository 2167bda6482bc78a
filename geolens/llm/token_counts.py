"""Token counts under a unigram model, found once for each shared prefix of the pre-tokens.

Pre-tokens are white-space separated words with the vocabulary's mark of a word's begin.  A task keeps its distinct
pre-tokens in a trie.  A node holds the cost and the number of tokens of the cheapest segmentation of the prefix
it stands for, computed from its ancestors when the node is made, so prefixes shared by many pre-tokens are scored
once; a pre-token's count is stored at its terminal.  A text's count is the sum over its pre-tokens.

The model is not trained: the pieces are those of a public vocabulary, and a piece of rank r costs
log(r + 2) (Zipf), in whole ten-thousandths, so sums are exact.  A character that no piece covers costs one token
for each of its UTF-8 bytes.  Of equally cheap segmentations the one with fewer tokens counts.

Nothing is shuffled.  A trie of more than ``NODES`` nodes is dropped and begun anew; that costs time, never counts.

Defined cases: a null or empty text has no pre-tokens and no tokens; repeated rows are counted one by one; columns
named like a result column are replaced; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from geolens.llm.words import Texts, chunks

NODES = 400_000
BEGIN = "▁"
BYTE_COST = 200_000


class Vocabulary:
    """Pieces of a vocabulary file with their costs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.cost = {model.id_to_piece(i): round(10_000 * math.log(rank + 2)) for rank, i in enumerate(kept)}
        self.longest = max(map(len, self.cost))
        self.suffixes = self._suffixes()

    def _suffixes(self) -> set[str]:
        """Endings of pieces: where one is not among them, no longer piece ends there."""
        return {piece[i:] for piece in self.cost for i in range(len(piece))}


class Trie:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.parent, self.letter, self.cost, self.tokens = [0], [""], [0], [0]
        self.terminal: dict[bytes, int] = {}

    def _add(self, parent: int, letter: str) -> int:
        cost, tokens = self.cost[parent] + BYTE_COST * len(letter.encode()), self.tokens[parent] + len(letter.encode())
        known, ends = self.vocabulary.cost, self.vocabulary.suffixes
        piece, before = letter, parent
        while piece in ends:
            own = known.get(piece)
            if own is not None:
                c = self.cost[before] + own
                t = self.tokens[before] + 1
                if c < cost or (c == cost and t < tokens):
                    cost, tokens = c, t
            if before == 0:
                break
            piece, before = self.letter[before] + piece, self.parent[before]
        node = len(self.parent)
        self.parent.append(parent)
        self.letter.append(letter)
        self.cost.append(cost)
        self.tokens.append(tokens)
        self.child[parent, letter] = node
        return node

    def count(self, word: bytes) -> int:
        found = self.terminal.get(word)
        if found is None:
            node = 0
            for letter in BEGIN + word.decode():
                node = self.child.get((node, letter)) or self._add(node, letter)
            found = self.terminal[word] = self.tokens[node]
            if len(self.parent) > NODES:
                self.clear()
        return found


_TRIES: dict[str, Trie] = {}


def _trie(path: str) -> Trie:
    """One trie for each Python worker."""
    if path not in _TRIES:
        _TRIES[path] = Trie(Vocabulary(path))
    return _TRIES[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", passing: list[str] | None = None) -> DataFrame:
    """The columns ``passing`` (default: all) of each document with ``n_pretokens`` and ``n_tokens``."""
    names = [c for c in passing or docs.columns if c not in ("n_pretokens", "n_tokens")]
    plain = docs.select(*dict.fromkeys([*names, text]))
    at = plain.columns.index(text)
    schema = ", ".join(f"`{n}` {plain.schema[n].dataType.simpleString()}" for n in names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(vocabulary)
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in chunks(batch, f"c{at}"):
                texts = Texts(part.column(at))
                words = [texts.one(i).split() for i in range(len(texts))]
                pre = pa.array([len(x) for x in words], pa.int64())
                sums = pa.array([sum(map(trie.count, x)) for x in words], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pre, sums], names=[*names, "n_pretokens", "n_tokens"])

    return plain.mapInArrow(count, f"{schema}, n_pretokens long, n_tokens long")
