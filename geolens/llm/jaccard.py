"""Exact n-gram Jaccard join by universe partition, one-deletion neighbourhoods and exact verification.

A document is its set of distinct 4-word shingles (64-bit hashes).  Sets fall into bands by size such that a
linked pair lies in one band or in two neighbouring ones.  A band bounds the symmetric difference of its linked
pairs by some H.  Its universe is hashed into segments, and by the pigeonhole principle:

* small sets: ``ceil((H+1)/2)`` segments; some segment differs by one shingle at most, so a set gives every
  segment and every segment less one shingle (its one-deletion neighbourhood);
* larger sets: ``H+1`` segments; some segment is equal in both sets, so a set gives its segments.

Segments of at most ``w`` shingles are equal in many unlinked sets.  They are not used.  Instead a set with t of
them gives the one-deletion neighbourhoods of its first segments, in a fixed order, until t of these have two
shingles or more.  If a linked pair agrees only in c <= t unused segments, the others all differ, by H in all, so
at most c - 1 of them differ by more than one shingle, and of the first c rich ones one differs by exactly one;
both sets give it.  (A set with fewer than t rich segments uses its poor segments after all.)  ``w`` is chosen for
each band by the cost of one set: more signatures against more meetings, whatever the number of sets.

Equal sets are one class and give their signatures once.  Signatures are shuffled; sets that meet are candidates.
Each set has a sketch, the parities of the numbers of its shingles in one to two bins a shingle (a 64th to a 32nd of
the set).  A shingle that only one of two sets holds changes one parity, so two sets differ by as many shingles at least
as their sketches do by bits; candidates that differ too much for a link are dropped before their sets move.
Buckets without an active member hold none and are left out; tables are deleted once the next ones stand.
A bucket of few sets gives its pairs.  A larger one is never expanded: its members are verified against one hub and
what is linked becomes one component.  Buckets that still hold several components are crowds.  Sets of a crowd
with too few shingles in other components leave it; the others are settled group by group in blocks inside the
tasks, which return joining links only.  So no link between components is lost, whatever the bucket sizes, and
pairs of a crowd are never rows.  Verification intersects the full sets: 100 * intersection >= 85 * union.

Memory: a task holds a few MB of text, or one hub and a batch of members, or two blocks of a crowd.  Only tables of checked size are
broadcast (ids of candidates, up to ``BROADCAST_ROWS``); larger ones are joined by shuffle.

Hashes: shingles are told apart by 64 bits, sets by 64 bits as class id; a second 64-bit digest guards the class
id, and a clash stops the job with a request for another ``seed``.

Defined cases: null or empty texts, and texts of white space, have no set and are linked with nothing, not even
with each other; their component is their own id.  Null ids never become a component's id unless all its ids are
null.  Repeated rows are copies.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens.llm.words import NOT_SPACE, Texts, Words, chunks, mix, window_firsts, windows
from geolens.session import cut_lineage, discard, release_shuffles

SHINGLE = 4
PERCENT = 85
FEW = 6  # sets of a bucket that gives all its pairs
SMALL = 48  # largest set size of the bands that use one-deletion neighbourhoods of all segments
PASSAGE = 50
BROADCAST_ROWS = 1_000_000
MEMBERS_PER_TASK = 400
BLOCK_SETS = 500
BLOCK_TOKENS = 400_000

_U = np.uint64


# ---- sets ----------------------------------------------------------------------


class Sets:
    """Sorted distinct shingle hashes of each text of a chunk, and 64-bit digests of the sets."""

    def __init__(self, texts: Texts, shingle: int, seed: int):
        words = Words(texts, NOT_SPACE, lower=True)
        hashes = words.hashes()
        count = np.diff(words.first)
        first, owner = window_firsts(words.first, shingle)
        all_ = windows(hashes, shingle)
        tokens = all_[first] if len(first) else np.empty(0, _U)
        short = np.flatnonzero((count > 0) & (count < shingle))
        if len(short):
            a = [windows(hashes[words.first[i] : words.first[i + 1]], int(count[i])) for i in short]
            tokens = np.concatenate((tokens, mix(np.concatenate(a) + count[short].astype(_U))))
            owner = np.concatenate((owner, short))
            order = np.argsort(owner, kind="stable")
            tokens, owner = tokens[order], owner[order]
        at = np.searchsorted(owner, np.arange(len(count) + 1))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            tokens[a:b].sort()
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        self.tokens, self.owner = tokens[new], owner[new]
        self.at = np.searchsorted(self.owner, np.arange(len(count) + 1))
        self.size = np.diff(self.at)
        self.ids = self._digest(seed)
        self.guards = self._digest(seed + 1)

    def sketches(self) -> pa.ListArray:
        """Parities of the numbers of shingles in each of 64, 128, 256, ... bins, at least as many as shingles, in words."""
        words = 1 << np.ceil(np.log2(np.maximum(self.size / 64, 1))).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(words)))
        bin_ = (mix(self.tokens ^ _U(99)) & (64 * words[self.owner] - 1).astype(_U)).astype(np.int64)
        odd = (np.bincount(64 * at[self.owner] + bin_, minlength=64 * int(at[-1])) & 1).astype(np.uint8)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))

    def _digest(self, seed: int) -> np.ndarray:
        total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(self.tokens ^ mix(np.array([seed + 7], _U))), dtype=_U)))
        return mix(total[self.at[1:]] - total[self.at[:-1]] + self.size.astype(_U)).view(np.int64)


# ---- bands and their allocation -------------------------------------------------


def bands(limit: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, H) of each band up to a band that holds ``limit``."""
    out, low = [], 1
    while not out or low <= limit:
        high = low * 100 // percent
        out.append((low, high, (100 - percent) * (high + high * 100 // percent) // (100 + percent)))
        low = high + 1
    return out


def light_limit(low: int, segments: int) -> int:
    """Shingles of an unused segment at most: 0 or 1, whichever costs less for a set of the band.

    Unit: one signature.  Segments hold Poisson numbers of shingles; every unused one costs a one-deletion
    neighbourhood.  For single shingles the worst case is taken, a passage of ``PASSAGE`` shingles that a third of the
    band's sets share: each of its shingles that is alone in a segment makes them meet, which costs a row, and once
    a set is a candidate its shingles are shuffled and counted.  Both costs are for one set, so the choice
    doesn't change with the number of sets.
    """
    mean = low / segments
    alone = np.exp(-mean)
    more = segments * alone * mean * (mean + 1)
    meetings = PASSAGE * alone
    false = (meetings + min(1.0, meetings) * 2 * low) / 3
    return int(more < false)


class Allocation:
    def __init__(self, limit: int, percent: int, small: int):
        self.bands = bands(limit, percent)
        self.lows = np.array([b[0] for b in self.bands])
        self.h = np.array([b[2] for b in self.bands])
        self.deletion = np.array([b[1] <= small for b in self.bands])
        self.segments = np.where(self.deletion, (self.h + 2) // 2, self.h + 1)
        self.light = np.array([light_limit(b[0], b[2] + 1) for b in self.bands])

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, size, side="right") - 1


def _sum_by(slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values modulo 2^64; halves stay exact in doubles."""
    low = np.bincount(slot, weights=(value & _U(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(slot, weights=(value >> _U(32)).astype(np.float64), minlength=n)
    return low.astype(_U) + (high.astype(_U) << _U(32))


def signatures(sets: Sets, which: np.ndarray, plan: Allocation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, active) of the chosen sets: two sets are candidates if they share a key and one of them is active there."""
    keys, ids, active = [], [], []
    own = plan.band(sets.size)
    for step in (0, 1):  # as a member of the own band, and as the larger set of a pair with the band below
        k = own - step
        use = which & (sets.size > 0) & (k >= 0)
        use &= plan.h[np.maximum(k, 0)] > 0  # else only equal sets are linked
        if not use.any():
            continue
        token = use[sets.owner]
        h, owner = sets.tokens[token], sets.owner[token]
        band = np.where(use, k, 0)
        m = np.where(use, plan.segments[band], 0)
        base = np.concatenate(([0], np.cumsum(m)))
        n = int(base[-1])
        salt = mix(band.astype(_U) + _U(1000))
        seg = (mix(h ^ salt[owner]) % m[owner].astype(_U)).astype(np.int64)
        slot = base[owner] + seg
        value = mix(h + salt[owner])
        total = _sum_by(slot, value, n)
        count = np.bincount(slot, minlength=n)
        doc = np.repeat(np.arange(len(m)), m)
        place = np.arange(n) - base[doc]
        where = mix(salt[doc] + place.astype(_U))
        deletion = plan.deletion[band][doc]
        light = ~deletion & (count <= plan.light[band][doc])
        rich = count >= 2
        t = np.bincount(doc[light], minlength=len(m))
        n_rich = np.bincount(doc[rich], minlength=len(m))
        before = np.cumsum(rich) - rich
        before -= before[np.minimum(base[:-1], n - 1)][doc]
        prefix = deletion | (before < t[doc])
        full = np.flatnonzero(~deletion)
        keys.append(mix(total[full] + where[full]))
        ids.append(doc[full])
        active.append(np.where(light[full], (n_rich < t)[doc[full]], True))
        full = np.flatnonzero(prefix & (deletion | (count >= 1)))
        keys.append(mix(total[full] ^ mix(where[full])))
        ids.append(doc[full])
        active.append(np.ones(len(full), bool))
        less = np.flatnonzero(prefix[slot] & (deletion[slot] | (count[slot] >= 2)))
        keys.append(mix((total[slot[less]] - value[less]) ^ mix(where[slot[less]])))
        ids.append(owner[less])
        active.append(np.zeros(len(less), bool))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(keys).view(np.int64), sets.ids[np.concatenate(ids)], np.concatenate(active)


# ---- passes over the documents ----------------------------------------------------


def _in_parts(columns: list[np.ndarray], names: list[str], size: int = 500_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), size):
        yield pa.record_batch([pa.array(c[a : a + size]) for c in columns], names)


def set_sizes(docs: DataFrame, text: str, doc: str, shingle: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, id, guard, sketch) of each document; id is null for an empty set."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(Texts(part.column("text")), shingle, seed)
                none = sets.size == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sets.size.astype(np.int64)), pa.array(sets.ids, mask=none), pa.array(sets.guards, mask=none), sets.sketches()],
                    names=["doc_id", "n_shingles", "id", "guard", "sketch"],
                )

    plain = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(sizes, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_shingles long, id long, guard long, sketch array<long>")


def _first_seen(sets: Sets, seen: set[int]) -> np.ndarray:
    """Sets that this task meets for the first time; forgetting some would only repeat rows."""
    if len(seen) > 1_000_000:
        seen.clear()
    out = np.zeros(len(sets.size), bool)
    for i, x in enumerate(sets.ids.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _signature_rows(docs: DataFrame, text: str, shingle: int, seed: int, plan: Allocation) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(Texts(part.column("text")), shingle, seed)
                yield from _in_parts([*signatures(sets, _first_seen(sets, seen), plan)], ["key", "id", "active"])

    return docs.select(F.col(text).alias("text")).mapInArrow(emit, "key long, id long, active boolean")


def _set_rows(docs: DataFrame, text: str, shingle: int, seed: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(Texts(part.column("text")), shingle, seed)
                new = np.flatnonzero(_first_seen(sets, seen) & (sets.size > 0))
                tokens = sets.tokens[np.isin(sets.owner, new)].view(np.int64)
                at = np.concatenate(([0], np.cumsum(sets.size[new])))
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(sets.ids[new]), column], names=["id", "tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(emit, "id long, tokens array<long>")


# ---- candidates ---------------------------------------------------------------------


def _meet(rows: DataFrame) -> DataFrame:
    """(large, a, b, active): pairs (a, b) of small buckets; of large ones the members, key in a and id in b."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        open_key: int | None = None  # a large bucket that goes on

        def settle(key, id_, act, last: bool):
            nonlocal held, open_key
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(start)
            size = np.diff(np.append(first, len(key)))
            n = len(first)
            large = size > FEW
            if n and open_key is not None:
                large[0] |= key[0] == open_key
            done = n if last else n - 1
            if not last and n and large[-1]:  # what there is of the last bucket is already enough
                open_key, done = int(key[-1]), n
                held = tuple(x[:0] for x in (key, id_, act))
            elif not last and n:
                held = tuple(x[first[-1] :] for x in (key, id_, act))
            rows_of = np.repeat(large[:done], size[:done])
            m = len(rows_of)
            out = [(np.ones(int(rows_of.sum()), bool), key[:m][rows_of], id_[:m][rows_of], act[:m][rows_of])]
            few = np.flatnonzero(~large[:done] & (size[:done] > 1))
            for k in np.unique(size[few]):
                at = first[few[size[few] == k]]
                for i in range(k):
                    for j in range(i + 1, k):
                        x, y = id_[at + i], id_[at + j]
                        ok = (x != y) & (act[at + i] | act[at + j])
                        x, y = x[ok], y[ok]
                        out.append((np.zeros(len(x), bool), np.minimum(x, y), np.maximum(x, y), np.ones(len(x), bool)))
            return [np.concatenate(c) for c in zip(*out)]

        for batch in batches:
            key, id_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            act = batch.column(2).to_numpy(zero_copy_only=False)
            key, id_, act = (np.concatenate((a, b)) for a, b in zip(held, (key, id_, act)))
            same = (key[1:] == key[:-1]) & (id_[1:] == id_[:-1])  # active rows come first
            keep = np.concatenate(([True], ~same)) if len(key) else np.empty(0, bool)
            out = settle(key[keep], id_[keep], act[keep], False)
            yield from _in_parts(out, ["large", "a", "b", "active"])
        if len(held[0]):
            yield from _in_parts(settle(*held, True), ["large", "a", "b", "active"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "id", F.desc("active"))
    return dealt.mapInArrow(meet, "large boolean, a long, b long, active boolean")


def _checked(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table whose number of rows was counted and is bounded."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def possible(pairs: DataFrame, shapes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that may be linked by their sizes and sketches, from (id, n, sketch) of each set.

    100 * intersection >= percent * union means (100 + percent) * difference <= (100 - percent) * sum of the sizes.
    A sketch of twice the bins is folded; pairs whose sketches differ more in length are kept if their sizes allow it.
    """
    for side in ("a", "b"):
        pairs = pairs.join(shapes.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_s")), side)
    words = F.least(F.size("a_s"), F.size("b_s"))

    def folded(sketch: F.Column) -> F.Column:
        halves = F.zip_with(F.slice(sketch, F.lit(1), words), F.slice(sketch, words + 1, words), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(sketch) == words, sketch).when(F.size(sketch) == 2 * words, halves)

    other = F.zip_with(folded(F.col("a_s")), folded(F.col("b_s")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    bits = F.coalesce(F.aggregate(other, F.lit(0), lambda total, n: total + n), F.lit(0)).cast("long")
    small = lambda differ: (100 + percent) * differ <= (100 - percent) * (F.col("a_n") + F.col("b_n"))
    return pairs.filter(small(F.abs(F.col("a_n") - F.col("b_n")))).filter(small(bits)).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The linked ones of the pairs (a, b), a the hub, and a written table that they are read from.

    A hub is copied for each ``MEMBERS_PER_TASK`` of its members.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("parts"))
    members = pairs.join(hubs, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("id"), F.lit(1).alias("role"))
    hubs = hubs.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"), F.lit(0).alias("role"))
    asked = cut_lineage(members.unionByName(hubs))
    rows = sets.join(_checked(asked, asked.count()), "id")
    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").select("hub", "role", "id", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, np.empty(0, _U)
        for batch in batches:
            hubs_, roles, ids = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            tokens, at = lists.values.to_numpy().view(_U), lists.offsets.to_numpy()  # sorted as unsigned
            found_a, found_b = [], []
            starts = np.flatnonzero(np.concatenate(([True], (hubs_[1:] != hubs_[:-1]) | (roles[1:] < roles[:-1])))) if len(ids) else []
            for a, b in zip(starts, np.append(starts[1:], len(ids)) if len(ids) else ()):
                first = a
                while first < b and roles[first] == 0:
                    hub, mine = hubs_[first], tokens[at[first] : at[first + 1]]
                    first += 1
                if first == b:
                    continue
                if hub != hubs_[first]:
                    raise ValueError("a hub's set is missing")
                theirs = tokens[at[first] : at[b]]
                spot = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                hits = np.concatenate(([0], np.cumsum(mine[spot] == theirs)))
                both = hits[at[first + 1 : b + 1] - at[first]] - hits[at[first:b] - at[first]]
                union = len(mine) + np.diff(at[first : b + 1]) - both
                good = np.flatnonzero(100 * both >= percent * union) + first
                found_a.append(hubs_[good])
                found_b.append(ids[good])
            if found_a:
                yield from _in_parts([np.concatenate(found_a), np.concatenate(found_b)], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long"), asked


# ---- components ---------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots themselves, for a written table of links (a, b).

    Every node hangs on its smallest neighbour, if that is smaller; such trees are flattened by pointer jumping.
    Links between different trees are links of the next, much smaller round.
    """
    labels, given = None, links
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = cut_lineage(both.filter("b < a").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("moved", F.lit(True)))
        while True:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = tree.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            jumped = cut_lineage(jumped)
            ended = jumped.filter("moved").isEmpty()
            discard(tree)
            tree = jumped
            if ended:
                break
        flat = tree.select("node", "root")
        last = labels
        if labels is None:
            labels = cut_lineage(flat)
        else:
            over = flat.select(F.col("node").alias("root"), F.col("root").alias("over"))
            labels = labels.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")).unionByName(flat)
            labels = cut_lineage(labels)
        before = links
        links = _labelled(_labelled(links, "a", "x", flat), "b", "y", flat).filter("x <> y")
        links = cut_lineage(links.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        discard(tree, last, before if before is not given else None)
        if links.isEmpty():
            discard(links)
            return labels


def _labelled(df: DataFrame, column: str, name: str, labels: DataFrame) -> DataFrame:
    found = labels.select(F.col("node").alias(column), F.col("root").alias(name))
    return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))


# ---- crowds: sets that meet in large buckets and are not linked by way of their hubs -----------


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components and an active member."""
    found = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("active").alias("any"))
    return members.join(found.filter("x <> y and any").select("key"), "key")


def _supported(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A written table (id, label, size) of the sets of which ``percent`` % of the shingles are also in crowd sets of other components.

    Others have no link into another component.  A count for each shingle, linear in the size of the sets.
    """
    tokens = sets.join(crowd, "id").select("id", "label", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    tokens = cut_lineage(tokens)
    shared = cut_lineage(tokens.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token"))
    have = tokens.join(_checked(shared, shared.count()), "token").groupBy("id", "label", "size").agg(F.count(F.lit(1)).alias("n"))
    found = cut_lineage(have.filter(100 * F.col("n") >= percent * F.col("size")).select("id", "label", "size"))
    discard(tokens, shared)
    return found


def _overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Intersection sizes of the sets of two blocks, each given as shingles and the number of their set, counted from 0."""
    (ta, ra), (tb, rb) = a, b
    na, nb = int(ra.max()) + 1, int(rb.max()) + 1
    known = np.intersect1d(ta, tb)
    out = np.zeros((na, nb), np.int32)
    if not len(known):
        return out
    sides = []
    for t, r in (a, b):
        spot = np.minimum(np.searchsorted(known, t), len(known) - 1)
        hit = known[spot] == t
        spot, r = spot[hit], r[hit]
        order = np.argsort(spot, kind="stable")
        sides.append((spot[order], r[order], np.bincount(spot, minlength=len(known))))
    (sa, ra, ca), (sb, rb, cb) = sides
    frequent = ca * cb > max(na * nb // 100, 64)  # these by matrix products, the others pair by pair
    for start in range(0, len(common := np.flatnonzero(frequent)), 512):
        part = common[start : start + 512]
        place = np.full(len(known), -1)
        place[part] = np.arange(len(part))
        x, y = np.zeros((na, len(part)), np.float32), np.zeros((nb, len(part)), np.float32)
        x[ra[place[sa] >= 0], place[sa][place[sa] >= 0]] = 1
        y[rb[place[sb] >= 0], place[sb][place[sb] >= 0]] = 1
        out += (x @ y.T).astype(np.int32)
    ia, ib = np.flatnonzero(~frequent[sa]), np.flatnonzero(~frequent[sb])
    first = np.concatenate(([0], np.cumsum(np.where(frequent, 0, cb))))
    reps = cb[sa[ia]]
    left = np.repeat(ra[ia], reps)
    inner = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
    right = rb[ib][np.repeat(first[sa[ia]], reps) + inner]
    out += np.bincount(left * nb + right, minlength=na * nb).reshape(na, nb).astype(np.int32)
    return out


def _joined(ids: np.ndarray, labels: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``linked`` (sets x sets) and equal labels join: to each other component at most one a set."""
    number = np.unique(labels, return_inverse=True)[1]
    x, y = np.nonzero(linked)
    apart = number[x] != number[y]
    x, y = x[apart], y[apart]
    low = number.copy()
    while True:
        m = low.copy()
        np.minimum.at(m, x, low[y])
        np.minimum.at(m, y, low[x])
        group = np.full(len(low), len(low))  # sets of one component stay together
        np.minimum.at(group, number, m)
        m = group[number]
        if np.array_equal(m, low):
            break
        low = m
    first = np.full(len(low) + 1, -1)
    first[low[::-1]] = np.arange(len(low))[::-1]
    root = first[low]
    moved = np.flatnonzero(number != number[root])
    return ids[root[moved]], ids[moved]


def crowd_links(crowd: DataFrame, sets: DataFrame, plan: Allocation, percent: int = PERCENT) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that join the linked sets of each group of a written crowd (id, label, size, grp).

    Sets of one group and band are dealt into blocks of bounded size; a block meets every block of its band and of
    the band above inside a task, where intersections are matrix products and sums over shared shingles.  Pairs
    are no rows: a task returns joining links only, at most one a set.  Also the written tables they are read from.
    """
    lows = F.array(*[F.lit(int(x)) for x in plan.lows])
    crowd = crowd.withColumn("band", F.size(F.filter(lows, lambda x: x <= F.col("size"))) - 1)
    blocks = crowd.groupBy("grp", "band").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_TOKENS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    blocks = cut_lineage(blocks)
    near = lambda step: blocks.select("grp", (F.col("band") + step).alias("band"), F.col("blocks").alias("above" if step < 0 else "below"))
    dealt = crowd.join(blocks, ["grp", "band"]).join(near(-1), ["grp", "band"], "left").join(near(1), ["grp", "band"], "left")
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    number = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda step, x, y, side: F.struct(step.alias("low"), x.alias("x"), y.alias("y"), side.alias("side"))
    band = F.col("band")
    at = F.concat(
        F.transform(number(F.col("blocks")), lambda j: place(2 * band, F.least(own, j), F.greatest(own, j), (own > j).cast("int"))),
        F.transform(number(F.col("above")), lambda j: place(2 * band + 1, own, j, F.lit(0))),
        F.transform(number(F.col("below")), lambda j: place(2 * band - 1, j, own, F.lit(1))),
    )
    asked = cut_lineage(dealt.select("id", "label", "grp", F.explode(at).alias("at")).select("id", "label", "grp", "at.*"))
    unit = ["grp", "low", "x", "y"]
    rows = sets.join(_checked(asked, asked.count()), "id").repartition(*unit).sortWithinPartitions(*unit, "side")
    rows = rows.select(F.xxhash64(*unit).alias("unit"), "side", "id", "label", "tokens")

    def meet(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        side = np.concatenate([h[0] for h in held])
        ids, labels = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        tokens, size = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        split = int((side == 0).sum())
        owner = np.repeat(np.arange(len(ids)), size)
        linked = np.zeros((len(ids), len(ids)), bool)
        if split == len(ids):
            both = _overlaps((tokens, owner), (tokens, owner))
            linked[:] = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        elif split:
            left = owner < split
            both = _overlaps((tokens[left], owner[left]), (tokens[~left], owner[~left] - split))
            linked[:split, split:] = 100 * both >= percent * (size[:split, None] + size[None, split:] - both)
        return _joined(ids, labels, linked)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            units, side, ids, labels = (batch.column(i).to_numpy() for i in range(4))
            lists = batch.column(4)
            tokens, offsets = lists.values.to_numpy().view(_U), lists.offsets.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1]))) if len(units) else []
            for a, b in zip(starts, np.append(starts[1:], len(units)) if len(units) else ()):
                if units[a] != now:
                    if held:
                        yield from _in_parts([*meet(held)], ["a", "b"])
                    held, now = [], units[a]
                held.append((side[a:b].copy(), ids[a:b].copy(), labels[a:b].copy(), tokens[offsets[a] : offsets[b]].copy(), np.diff(offsets[a : b + 1])))
        if held:
            yield from _in_parts([*meet(held)], ["a", "b"])

    return rows.mapInArrow(settle, "a long, b long"), [blocks, asked]


def link_components(pairs: DataFrame, star: DataFrame, members: DataFrame, sets: DataFrame, plan: Allocation, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the linked sets, from written pairs (a, b), pairs with hubs and bucket members (key, id, active).

    1. Each set is verified against the smallest set that it meets and may be linked with.
    2. Pairs that this leaves in different components are verified, and large buckets that it leaves with several
       components become crowds: groups of sets that meet, each settled block by block.
    """
    tested = cut_lineage(pairs.select("a", "b").unionByName(star).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found, asked = verify(tested, sets, percent)
    links = cut_lineage(found.distinct())
    discard(asked)
    labels = components(links)

    apart = _labelled(_labelled(pairs, "a", "x", labels), "b", "y", labels).filter("x <> y").select("a", "b")
    apart = cut_lineage(apart.join(tested, ["a", "b"], "left_anti"))
    mixed = cut_lineage(_mixed(_labelled(members, "id", "label", labels)))
    crowd = cut_lineage(mixed.select("id", "label").distinct())
    discard(tested, labels)
    more, asked = verify(apart, sets, percent)
    read = [asked, apart, mixed, crowd]
    if not crowd.isEmpty():
        crowd = _supported(crowd, sets, percent)
        mixed = _mixed(mixed.join(crowd.select("id"), "id", "left_semi"))
        meeting = mixed.join(mixed.groupBy("key").agg(F.min("id").alias("a")), "key").filter("a <> id").select("a", F.col("id").alias("b"))
        meeting = cut_lineage(meeting.distinct())
        read += [crowd, meeting]
        if not meeting.isEmpty():
            inside = meeting.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            groups = components(meeting)
            crowd = cut_lineage(_labelled(crowd.join(inside, "id"), "id", "grp", groups))
            inner, tables = crowd_links(crowd, sets, plan, percent)
            more = more.unionByName(inner)
            read += [groups, crowd, *tables]
    every = cut_lineage(links.unionByName(more).distinct())
    discard(links, *read)
    return components(every)


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, seed: int = 0) -> DataFrame:
    """A written table (doc_id, n_shingles, component_id) of each document; all others are deleted on the way."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    sizes = cut_lineage(set_sizes(docs, "text", "doc_id", shingle, seed))
    classes = cut_lineage(sizes.filter("id is not null").groupBy("id").agg(F.min("n_shingles").alias("n"), F.min("guard").alias("g"), F.max("guard").alias("h"), F.min("doc_id").alias("first"), F.first("sketch").alias("sketch")))
    if not classes.filter("g <> h").isEmpty():
        raise ValueError("two sets share a class id; use another seed")
    plan = Allocation(classes.agg(F.max("n")).first()[0] or 1, percent, small)

    met = cut_lineage(_meet(_signature_rows(docs, "text", shingle, seed, plan)))
    release_shuffles(spark)
    pairs = cut_lineage(possible(met.filter("not large").select("a", "b").distinct(), classes, percent))
    members = met.filter("large").select(F.col("a").alias("key"), F.col("b").alias("id"), "active")
    members = cut_lineage(members.join(members.filter("active").select("key").distinct(), "key", "left_semi"))  # others hold no candidates
    discard(met)
    hub = members.filter("active").groupBy("key").agg(F.min("id").alias("a"))
    star = members.join(hub, "key").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).filter("a <> b")
    star = cut_lineage(possible(star.groupBy("b").agg(F.min("a").alias("a")), classes, percent))
    needed = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct())
    found = _set_rows(docs, "text", shingle, seed).join(_checked(needed, needed.count()), "id")
    sets = cut_lineage(found.dropDuplicates(["id"]))
    discard(needed)
    release_shuffles(spark)
    labels = link_components(pairs, star, members, sets, plan, percent)
    discard(pairs, star, members, sets)

    named = classes.join(labels, classes["id"] == labels["node"], "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(best, "root").select("id", "component_id")
    named = sizes.join(named, "id", "left").select("doc_id", "n_shingles", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = cut_lineage(named)
    discard(sizes, classes, labels)
    release_shuffles(spark)
    return out
