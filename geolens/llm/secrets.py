"""Secret scans: three base patterns, and a character convolutional network over every other candidate.

Candidates are runs of token characters, long and mixed enough to be keys.  A network sees each candidate with
the text around it.  It is trained on labelled findings of the corpus: candidates inside a base match are secrets;
others that read like words, paths or numbers are none; the rest has no label.  Since the base patterns know few
forms, ``MADE`` findings of each label are made of these: keys over other alphabets, of other lengths and with
prefixes, and names put together from words and numbers, all in contexts of other findings, and a copy of each secret
without its telling words.  The sample of the fit is bounded by ``TRAINING`` findings of each label, those with the
smallest hashes of all in the corpus, so it doesn't depend on how rows are dealt out.

Calibration and threshold come from the scores of all labelled findings of all documents: a pass over the documents
gives counts by label and score (in sixteenths), and the threshold is the highest that still finds ``RECALL`` of the
secrets, and of made keys that the fit didn't see: forms without a base pattern count too.  The network reports the recall reached and the share of harmless findings it takes for secrets.

All passes are map-only up to these counts; weights (under 100 KB) travel with the tasks.

Defined cases: a null or empty text has no spans; with too few labelled findings of either kind no network is
trained and only base spans are found; repeated rows are scanned one by one; columns named like a result column
are replaced; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolens.llm.words import LOWER, Texts, Words, chunks

KINDS = ("assign", "access", "hex", "model")
TRAINING = 4000  # findings of each label at most
LEAST = 30  # of each label at least
RECALL = 0.98
MADE = 4000  # findings of each label made for training
BINS = 16  # of one unit of score
LEFT, BODY, RIGHT = 32, 48, 16
WIDTH = LEFT + BODY + RIGHT

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_TELLING = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 0x30) & (_BYTE <= 0x39)
_LETTER = ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_HEX = _DIGIT | ((_BYTE >= 0x61) & (_BYTE <= 0x66))
_TOKEN = _DIGIT | _LETTER | np.isin(_BYTE, list(b"+/_=-"))
#: Symbols of the network: 0 nothing, then printable ASCII, then all other bytes.
_SYMBOL = np.where((_BYTE >= 0x20) & (_BYTE < 0x7F), _BYTE - 0x20 + 1, 96)
SYMBOLS = 97


def base_spans(texts: Texts) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, kind, end) of the base matches in bytes, sorted."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    runs = Words(texts, _HEX, lower=False)
    for k in np.flatnonzero(runs.ends - runs.starts >= 24):
        i = int(np.searchsorted(texts.offsets, runs.starts[k], side="right")) - 1
        out.setdefault(i, []).append((int(runs.starts[k] - texts.offsets[i]), 2, int(runs.ends[k] - texts.offsets[i])))
    for kind, data, needles in ((1, texts.data.tobytes(), [b"AKIA"]), (0, LOWER[texts.data].tobytes(), _TELLING)):
        where = set()
        for needle in needles:
            at = data.find(needle)
            while at >= 0:
                i = int(np.searchsorted(texts.offsets, at, side="right")) - 1
                where.add(i)
                at = data.find(needle, int(texts.offsets[i + 1]))
        for i in where:
            for m in (_ASSIGN if kind == 0 else _ACCESS).finditer(texts.one(i)):
                if (len(m[2]) >= 6) if kind == 0 else (m.end() - m.start() >= 20):
                    out.setdefault(i, []).append((m.start(), kind, m.end()))
    for spans in out.values():
        spans.sort()
    return out


def candidates(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) in bytes: runs of 12 and more token characters with letters and digits, and of 16 and more."""
    runs = Words(texts, _TOKEN, lower=False)
    length = runs.ends - runs.starts
    long = np.flatnonzero(length >= 12)
    starts, ends = runs.starts[long], runs.ends[long]
    digits = np.concatenate(([0], np.cumsum(_DIGIT[texts.data])))
    letters = np.concatenate(([0], np.cumsum(_LETTER[texts.data])))
    mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
    good = mixed | (length[long] >= 16)
    starts, ends = starts[good], ends[good]
    owner = np.searchsorted(texts.offsets, starts, side="right") - 1
    return owner, starts - texts.offsets[owner], ends - texts.offsets[owner]


def views(texts: Texts, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of each candidate: the text before, the candidate (of a long one its two ends), the text after."""
    out = np.zeros((len(owner), WIDTH), np.uint8)
    for k, (i, a, b) in enumerate(zip(owner.tolist(), starts.tolist(), ends.tolist())):
        whole = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
        before, after = whole[max(0, a - LEFT) : a], whole[b : b + RIGHT]
        body = whole[a:b] if b - a <= BODY else np.concatenate((whole[a : a + BODY // 2], whole[b - BODY // 2 : b]))
        out[k, LEFT - len(before) : LEFT] = _SYMBOL[before]
        out[k, LEFT : LEFT + len(body)] = _SYMBOL[body]
        out[k, LEFT + BODY : LEFT + BODY + len(after)] = _SYMBOL[after]
    return out


# ---- the network ------------------------------------------------------------------


@dataclass
class Network:
    """Embedding, convolution of width 5, rectifier, maximum and mean over places, one logistic output, calibration."""

    embed: np.ndarray  # (SYMBOLS, d)
    place: np.ndarray  # (3, d): before, candidate, after
    filters: np.ndarray  # (5 * d, f)
    bias: np.ndarray  # (f,)
    out: np.ndarray  # (2 * f + 1,)
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    made_least: float = np.inf  # the score that RECALL of the made keys outside the fit reach
    recall: float = 1.0  # of labelled secrets, at the threshold
    mistaken: float = 0.0  # share of the labelled harmless findings at or above it

    @classmethod
    def fresh(cls, seed: int = 1, d: int = 8, f: int = 32) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape, by: (rng.standard_normal(shape) / by).astype(np.float32)
        return cls(make(SYMBOLS, d, by=2), make(3, d, by=2), make(5 * d, f, by=np.sqrt(5 * d)), np.zeros(f, np.float32), make(2 * f + 1, by=np.sqrt(2 * f)))

    def _forward(self, x: np.ndarray):
        part = np.repeat([0, 1, 2], [LEFT, BODY, RIGHT])
        e = self.embed[x] + self.place[part]
        cols = np.lib.stride_tricks.sliding_window_view(e, 5, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - 4, -1)
        z = cols @ self.filters + self.bias
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1), np.ones((len(x), 1), np.float32)), axis=1)
        return cols, z, top, pooled, pooled @ self.out

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0, np.float32)
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x).astype(np.float64) + self.shift)))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        cols, z, top, pooled, s = self._forward(x)
        n, f = len(x), self.filters.shape[1]
        ds = ((1 / (1 + np.exp(-s)) - y) * weight / n).astype(np.float32)
        dout = pooled.T @ ds
        dp = ds[:, None] * self.out[None, :]
        da = np.repeat(dp[:, None, f : 2 * f] / z.shape[1], z.shape[1], axis=1)
        rows, fs = np.arange(n)[:, None], np.arange(f)[None, :]
        da[rows, top, fs] += dp[:, :f]
        dz = da * (z > 0)
        flat = dz.reshape(-1, f)
        dfilters, dbias = cols.reshape(-1, cols.shape[-1]).T @ flat, flat.sum(axis=0)
        dcols = (flat @ self.filters.T).reshape(n, WIDTH - 4, 5, -1)
        de = np.zeros((n, WIDTH, dcols.shape[-1]), np.float32)
        for k in range(5):
            de[:, k : k + WIDTH - 4] += dcols[:, :, k]
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, x.ravel(), de.reshape(-1, de.shape[-1]))
        by_place = de.sum(axis=0)
        dplace = np.stack([by_place[:LEFT].sum(axis=0), by_place[LEFT : LEFT + BODY].sum(axis=0), by_place[LEFT + BODY :].sum(axis=0)])
        return [dembed, dplace, dfilters, dbias, dout]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.filters, self.bias, self.out]


_SIGNS = "".join(map(chr, range(0x30, 0x3A))), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABETS = [
    *(_SIGNS[0] + _SIGNS[1] + _SIGNS[2] + more for more in ("", "+/", "-_")),
    _SIGNS[0] + _SIGNS[1],
    _SIGNS[0] + _SIGNS[2],
    _SIGNS[0] + "abcdef",
    _SIGNS[0] + "ABCDEF",
]


def _made_key(rng: np.random.Generator) -> str:
    """A random key: of one alphabet, 16 to 64 long, some with a prefix, some in groups."""
    signs = _ALPHABETS[rng.integers(len(_ALPHABETS))]
    key = "".join(rng.choice(list(signs), rng.integers(16, 65)))
    if rng.random() < 0.25:
        size = int(rng.integers(8, 14))
        key = "-".join(key[i : i + size] for i in range(0, len(key), size))
    if rng.random() < 0.4:
        key = "".join(rng.choice(list(_SIGNS[1]), rng.integers(2, 6))) + "_-"[rng.integers(2)] + key
    return key


def _made_name(words: list[str], rng: np.random.Generator) -> str:
    """A name, path, number or date put together from words of the corpus and numbers."""
    kind = rng.random()
    number = lambda: "".join(rng.choice(list(_SIGNS[0]), rng.integers(1, 5)))
    if kind < 0.15:
        return "-/"[rng.integers(2)].join(number() for _ in range(rng.integers(4, 9)))
    if kind < 0.25:
        return "".join(rng.choice(list(_SIGNS[0]), rng.integers(12, 33)))
    parts = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 6))]
    if rng.random() < 0.5:  # words that the corpus doesn't have, from a beginning and an end of others
        parts = [w[: rng.integers(2, 6)] + words[rng.integers(len(words))][-int(rng.integers(2, 5)) :] for w in parts]
    if kind < 0.45:
        parts = [w.capitalize() for w in parts]
    elif kind < 0.6:
        parts = [w.upper() for w in parts]
    if rng.random() < 0.4:
        parts.insert(int(rng.integers(1, len(parts) + 1)), number())
    return ("", "_", "/", "-")[rng.integers(1 if kind >= 0.45 else 0, 4)].join(parts)


def made(x: np.ndarray, y: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` made findings of each label in contexts of the given ones."""
    plain = np.where((x > 0) & (x < 96), x + 0x1F, 0x20).astype(np.uint8)
    said = [bytes(v[LEFT : LEFT + BODY]).decode() for v in plain[y == 0]] + [bytes(v[:LEFT]).decode() for v in plain]
    words = sorted({w.lower()[:9] for s in said for w in re.findall("[A-Za-z]{3,}", s)}) or ["word"]
    out = x[rng.integers(0, len(x), 2 * n)].copy()
    out[:, LEFT + BODY :] = x[rng.integers(0, len(x), 2 * n), LEFT + BODY :]
    label = np.arange(2 * n) < n
    for row, key in zip(out, label):
        body = (_made_key(rng) if key else _made_name(words, rng)).encode()
        body = body if len(body) <= BODY else body[: BODY // 2] + body[-(BODY // 2) :]
        row[LEFT : LEFT + BODY] = 0
        row[LEFT : LEFT + len(body)] = _SYMBOL[np.frombuffer(body, np.uint8)]
    return out, label.astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, seed: int = 1, epochs: int = 8, batch: int = 64, recall: float = RECALL, more: int = MADE) -> Network:
    """A network fitted by Adam on four fifths of the findings and on made ones, calibrated on the rest."""
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(x)) % 5 == 0
    xt, yt = x[~held], y[~held].astype(np.float32)
    bare = xt[yt == 1].copy()
    bare[:, :LEFT][rng.random((len(bare), LEFT)) < 0.9] = _SYMBOL[0x20]
    new_x, new_y = made(xt, yt, more, rng)
    xt, yt = np.concatenate((xt, bare, new_x)), np.concatenate((yt, np.ones(len(bare), np.float32), new_y))
    weight = np.where(yt == 1, len(yt) / (2 * max(yt.sum(), 1)), len(yt) / (2 * max((1 - yt).sum(), 1))).astype(np.float32)
    net = Network.fresh(seed)
    first, second, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(epochs):
        order = rng.permutation(len(xt))
        for i in range(0, len(order), batch):
            b = order[i : i + batch]
            step += 1
            for p, g, m, v in zip(net.parameters(), net.gradients(xt[b], yt[b], weight[b]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    fresh_x, fresh_y = made(x[held], y[held], more, rng)
    net.made_least = float(np.quantile(net.logits(fresh_x[fresh_y == 1]), 1 - recall, method="lower"))
    calibrate(net, net.logits(x[held]), y[held], np.ones(int(held.sum())), recall)
    return net


def calibrate(net: Network, s: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
    """Logistic calibration by Newton steps, then the recall-constrained threshold, from ``n`` findings of each (score, label)."""
    s, y, n = s.astype(np.float64), y.astype(np.float64), n.astype(np.float64)
    n1, n0 = n[y == 1].sum(), n[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -500, 500)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(n * (p - target) * s).sum() + 1e-3 * (a - 1), (n * (p - target)).sum()])
        h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move /= max(1.0, np.abs(move).max())
        a, b = max(a - move[0], 1e-3), b - move[1]
    net.scale, net.shift = float(a), float(b)
    order = np.argsort(-s[y == 1], kind="stable")
    from_top = np.cumsum(n[y == 1][order])
    if len(from_top):
        least = min(net.made_least, s[y == 1][order][min(np.searchsorted(from_top, recall * n1 - 1e-9), len(from_top) - 1)])
        net.threshold = float(1 / (1 + np.exp(-(a * least + b))))
        net.recall = float(n[(y == 1) & (s >= least)].sum() / n1)
        net.mistaken = float(n[(y == 0) & (s >= least)].sum() / max(n0, 1.0))


# ---- passes over the documents -------------------------------------------------------


def reads_like_words(body: bytes) -> bool:
    """Words and numbers of four characters and more on average, whatever joins them."""
    pieces = re.findall(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", body)
    return bool(pieces) and sum(map(len, pieces)) >= 4 * len(pieces)


def _labelled(texts: Texts) -> tuple[np.ndarray, list[bool | None]]:
    """Views and labels of all candidates: inside a base match, like words, or neither (None)."""
    owner, starts, ends = candidates(texts)
    base = base_spans(texts)
    label: list[bool | None] = []
    for i, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist()):
        if any(a < y and x < b for x, _, y in base.get(i, ())):
            label.append(True)
        else:
            at = int(texts.offsets[i])
            # A long run of letters and digits is told by its ends, as in its view.
            body = texts.data[at + a : at + b] if b - a <= BODY else np.concatenate((texts.data[at + a : at + a + BODY // 2], texts.data[at + b - BODY // 2 : at + b]))
            label.append(False if reads_like_words(body.tobytes()) else None)
    return views(texts, owner, starts, ends), label


def findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(view, secret): all candidates of all documents that have a label."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                seen, label = _labelled(Texts(part.column("text")))
                kept = [k for k, x in enumerate(label) if x is not None]
                yield pa.record_batch([pa.array([seen[k].tobytes() for k in kept], pa.binary()), pa.array([label[k] for k in kept], pa.bool_())], ["view", "secret"])

    return docs.select(F.col(text).alias("text")).mapInArrow(find, "view binary, secret boolean")


def score_counts(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """(secret, score, n): all labelled candidates of all documents by score in sixteenths, rounded down."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                seen, label = _labelled(Texts(part.column("text")))
                known = np.array([x is not None for x in label], bool)
                score = np.floor(network.logits(seen[known]).astype(np.float64) * BINS).astype(np.int64)
                found.update(zip((x for x in label if x is not None), score.tolist()))
        if found:
            secret, score = zip(*found)
            yield pa.record_batch([pa.array(secret, pa.bool_()), pa.array(score, pa.int64()), pa.array(list(found.values()), pa.int64())], ["secret", "score", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "secret boolean, score long, n long")
    return counted.groupBy("secret", "score").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", training: int = TRAINING, least: int = LEAST) -> Network | None:
    """A network trained on the bounded sample of distinct findings, or None with fewer than ``least`` of either label.

    Both labels are sampled in one pass; a second one counts the scores of all findings, a few hundred rows.
    """
    rank = F.row_number().over(Window.partitionBy("secret").orderBy(F.xxhash64("view"), "view"))
    rows = findings(docs, text).distinct().withColumn("rank", rank).filter(F.col("rank") <= training).collect()
    rows.sort(key=lambda r: (not r["secret"], r["rank"]))
    y = np.array([r["secret"] for r in rows], bool)
    if min(y.sum(), (~y).sum()) < least:
        return None
    network = train(np.stack([np.frombuffer(r["view"], np.uint8) for r in rows]), y)
    counts = score_counts(docs, network, text).orderBy("secret", "score").collect()
    secret, score, n = (np.array(c) for c in zip(*counts))
    calibrate(network, score / BINS, secret, n)
    return network


_RESULT = "base_spans string, spans string, n_assign long, n_access long, n_hex long, secret_bytes array<struct<start: long, end: long>>"
_NAMES = ["base_spans", "spans", "n_assign", "n_access", "n_hex", "secret_bytes"]


def _masked(text: str, ranges: list[dict], mask: str) -> str:
    whole, kept, begin = text.encode(), [], 0
    for r in ranges:
        if r["start"] >= begin:
            kept += [whole[begin : r["start"]], mask.encode()]
        begin = max(begin, r["end"])
    return b"".join([*kept, whole[begin:]]).decode()


def scan(docs: DataFrame, network: Network | None, text: str = "text", mask: str | None = None) -> DataFrame:
    """``docs`` with all spans (kind:start:end in code points, comma-joined), counts of base spans, and byte ranges.

    With ``mask`` the texts come redacted, as from ``redact``; spans and ranges are those of the texts before.
    """
    docs = docs.drop(*_NAMES)
    names = docs.columns
    at = names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in chunks(batch, f"c{at}"):
                texts = Texts(part.column(at))
                base = base_spans(texts)
                spans = {i: list(v) for i, v in base.items()}
                if network is not None:
                    owner, starts, ends = candidates(texts)
                    free = np.array([not any(a < y and x < b for x, _, y in base.get(i, ())) for i, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist())], bool)
                    owner, starts, ends = owner[free], starts[free], ends[free]
                    sure = network.probability(views(texts, owner, starts, ends)) >= network.threshold
                    for i, a, b in zip(owner[sure].tolist(), starts[sure].tolist(), ends[sure].tolist()):
                        spans.setdefault(i, []).append((a, 3, b))
                n = len(texts)
                said, own, ranges = [""] * n, [""] * n, [[] for _ in range(n)]
                counts = np.zeros((4, n), np.int64)
                for i, found in spans.items():
                    found.sort()
                    data = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
                    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    parts = [(kind, f"{KINDS[kind]}:{point[a]}:{point[b]}") for a, kind, b in found]
                    said[i] = ",".join(x for _, x in parts)
                    own[i] = ",".join(x for kind, x in parts if kind < 3)
                    for kind, _ in parts:
                        counts[kind, i] += 1
                    ranges[i] = [{"start": a, "end": b} for a, _, b in found]
                new = [pa.array(own, pa.string()), pa.array(said, pa.string()), *(pa.array(counts[k]) for k in range(3))]
                new.append(pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                columns = [*part.columns]
                if mask is not None and spans:
                    column = part.column(at).to_pylist()
                    for i in spans:
                        column[i] = _masked(column[i], ranges[i], mask)
                    columns[at] = pa.array(column, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *new], names=[*names, *_NAMES])

    return docs.mapInArrow(look, f"{schema}, {_RESULT}")


def redact(found: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents of ``scan`` with ``mask`` in place of each range of secrets."""
    names, schema = found.columns, found.schema
    at, at_ranges = names.index(text), names.index("secret_bytes")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).to_pylist()
            for i, ranges in enumerate(batch.column(at_ranges).to_pylist()):
                if ranges:
                    column[i] = _masked(column[i], ranges, mask)
            arrays = [*batch.columns]
            arrays[at] = pa.array(column, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return found.mapInArrow(replace, schema)

