"""Vector code compression: product codes learnt by Lloyd rounds whose members stay where they are.

A vector is cut into equal parts.  Each part is a row that lives with the owner of its entry: rows are dealt by
(position, entry, salt), with as many salts for an entry as it has shares of members, so an entry that holds a third
of all parts has many owners.  In each round

* owners add up their resident members; as a task holds members of few entries, it gives few sums, which meet in one
  small aggregation.  New entries are the floored means (a table of positions x entries x components, whose size
  doesn't follow the data: it goes through the driver and back in the tasks' closure);
* tasks assign their residents anew.  Members that keep their entry are written where they are; only those that
  change it go through the shuffle, to their new owners.

All arithmetic is in whole numbers: components are floor(scale * x), distances are matrix products of numbers below
2^53, so results don't depend on partitioning.  Of equally near entries the first is taken; an entry without members
stays.  A generation of members is deleted when the next one stands.

Defined cases: a vector that is null or empty or holds null or non-finite components is dropped; vectors of several
lengths, a length that the parts don't divide, or components beyond 2^27 after scaling stop the job with an error; with
fewer vectors than entries there are so many entries; null and equal ids are fine (the first codebook takes nulls last
and equal ids by their components); repeated rows get a code each; an empty table gives no rows; columns named like a
result column are replaced, other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens.session import cut_lineage, discard, range_tasks, work_path, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 27
_EXACT = 1 << 21  # components below it: products of a part are exact in floating point
_ROWS = 4096  # of a matrix product
FEW_LABELS = 100_000
_OUT = ("code", "error")


@dataclass
class Codes:
    """``frame``: the passing columns with code and error; ``codebooks``: entries x components for each position."""

    frame: DataFrame
    codebooks: np.ndarray

    def sha256(self) -> str:
        """Of all entries' components, by part, entry and position within the part."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def nearest(vectors: np.ndarray, book: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance for each row; ``exact``: floating point holds all products."""
    entry, distance = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    if exact:
        turned, half = book.T.astype(np.float64), (book.astype(np.float64) ** 2).sum(axis=1)
        for a in range(0, len(vectors), _ROWS):
            rows = vectors[a : a + _ROWS].astype(np.float64)
            score = half - 2 * (rows @ turned)
            best = score.argmin(axis=1)
            entry[a : a + _ROWS] = best
            distance[a : a + _ROWS] = score[np.arange(len(rows)), best] + (rows**2).sum(axis=1)
    else:
        for i, row in enumerate(vectors):
            score = ((book - row) ** 2).sum(axis=1)
            entry[i] = score.argmin()
            distance[i] = score[entry[i]]
    return entry, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(batch: pa.RecordBatch, books: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    part = batch.column("part").to_numpy()
    vectors = _matrix(batch.column("v"), books.shape[2])
    entry, distance = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for p in range(len(books)):
        own = np.flatnonzero(part == p)
        entry[own], distance[own] = nearest(vectors[own], books[p], exact)
    return entry, distance


def _assign(members: DataFrame, books: np.ndarray, exact: bool) -> DataFrame:
    """Members with the entry now nearest to them, and whether it's another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, _ = _assigned(batch, books, exact)
            moved = pa.array(entry != batch.column("entry").to_numpy())
            kept = [pa.array(entry.astype(np.int32)) if n == "entry" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, moved], names=[*batch.schema.names, "moved"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    return members.mapInArrow(run, f"{schema}, moved boolean")


def _sums(members: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Members and their sum for each entry that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((shape[0] * shape[1], shape[2]), np.int64), np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            at = batch.column("part").to_numpy().astype(np.int64) * shape[1] + batch.column("entry").to_numpy()
            order = np.argsort(at, kind="stable")
            own, first, n = np.unique(at[order], return_index=True, return_counts=True)
            if len(own):
                total[own] += np.add.reduceat(_matrix(batch.column("v"), shape[2])[order].astype(np.int64), first, axis=0)
                count[own] += n
        used = np.flatnonzero(count)
        bounds = pa.array(np.arange(len(used) + 1, dtype=np.int32) * shape[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.ListArray.from_arrays(bounds, pa.array(total[used].ravel()))], names=["at", "n", "total"])

    partial = members.select("part", "entry", "v").mapInArrow(run, "at long, n long, total array<long>")
    whole = F.array(*[F.sum(F.col("total")[k]) for k in range(shape[2])])
    return partial.groupBy("at").agg(F.sum("n").alias("n"), whole.alias("total"))


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their members."""
    out = books.copy().reshape(-1, books.shape[2])
    for r in _sums(members, books.shape).collect():  # positions x entries rows at most
        out[r["at"]] = np.array(r["total"], np.int64) // r["n"]
    return out.reshape(books.shape)


def _owned(moving: DataFrame, parts: int, entries: int) -> DataFrame:
    """Members dealt to the owners of their entries; entries with many members have many owners."""
    counts = {(r["part"], r["entry"]): r["count"] for r in moving.groupBy("part", "entry").count().collect()}
    share = max(1, sum(counts.values()) // (4 * range_tasks(moving.sparkSession)))
    salts = F.array(*[F.lit(-(-counts.get((p, e), 1) // share)) for p in range(parts) for e in range(entries)])
    salt = F.pmod(F.xxhash64("row"), F.get(salts, F.col("part") * entries + F.col("entry")))
    return moving.repartition("part", "entry", salt)


def _settled(members: DataFrame, books: np.ndarray, exact: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Members after an assignment, and the written tables they are in.  Only those that change their entry migrate."""
    spark = members.sparkSession
    flagged = _assign(members, books, exact)
    path = work_path(spark, "members")
    flagged.write.partitionBy("moved").parquet(path)
    stay = written(spark, path, flagged.schema)
    moving = stay.filter("moved").drop("moved")
    arrived = cut_lineage(_owned(moving, len(books), books.shape[1]))
    return stay.filter("not moved").drop("moved").unionByName(arrived), [stay, arrived]


def compress(vectors: DataFrame, vec: str = "vec_id", vector: str = "embedding", passing: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all vectors, as many hex digit pairs as parts, with their squared errors, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    names = [c for c in passing or vectors.columns if c not in _OUT]
    spark = vectors.sparkSession
    bad = F.exists(F.col(f"`{vector}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col(f"`{vector}`").isNotNull() & (F.size(F.col(f"`{vector}`")) > 0) & ~F.coalesce(bad, F.lit(True)))
    own = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    whole = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale))
    kept = kept.select(F.col(f"`{vec}`").alias("id"), own.alias("own"), whole.alias("v"))

    found = kept.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("short"), F.max(F.size("v")).alias("long"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("far")).first()
    if not found["n"]:
        empty = kept.filter("false").select("own.*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(empty.toDF(*names, *_OUT), np.empty((parts, 0, 0), np.int64))
    if found["short"] != found["long"] or found["long"] % parts:
        raise ValueError(f"vectors of {found['short']} to {found['long']} components can't be cut into {parts} equal parts")
    if found["far"] >= LARGEST:
        raise ValueError(f"components of {found['far']} after scaling are beyond {LARGEST}")
    width, exact = found["long"] // parts, found["far"] < _EXACT

    last = kept.select("id").orderBy(F.asc_nulls_last("id")).limit(entries).agg(F.max(F.struct(F.col("id").isNull(), "id"))).first()[0]
    small = kept if last[0] else kept.filter(F.col("id") <= last[1])
    start = small.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)

    # Positions after the first one carry no columns of their own.
    kind = "int" if found["far"] < 1 << 31 else "long"
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), F.slice("v", p * width + 1, width).cast(f"array<{kind}>").alias("v"), F.when(p == 0, F.col("own")).alias("own")))
    rows = kept.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(cut).alias("p")).select("row", "p.part", F.lit(-1).alias("entry"), "p.v", "p.own")
    members, tables = rows, []
    for _ in range(rounds):
        members, new = _settled(members, books, exact)
        discard(*tables)
        tables = new
        books = _updated(members, books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, distance = _assigned(batch, books, exact)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), pa.array(entry), pa.array(distance), batch.column("own")], names=["row", "part", "entry", "distance", "own"])

    ended = members.mapInArrow(final, f"row long, part int, entry long, distance long, own {rows.schema['own'].dataType.simpleString()}")
    digits = [F.max(F.when(F.col("part") == p, F.lpad(F.lower(F.hex("entry")), 2, "0"))) for p in range(parts)]
    coded = ended.groupBy("row").agg(F.first(F.when(F.col("part") == 0, F.col("own")), ignorenulls=True).alias("own"), F.concat(*digits).alias("code"), F.sum("distance").alias("error"))
    out = cut_lineage(coded.select("own.*", "code", "error"))
    discard(*tables)
    return Codes(out.toDF(*names, *_OUT), books)


def with_totals(frame: DataFrame, label: str, total: str = "label_error") -> DataFrame:
    """The frame with the sum of ``error`` over equal labels, nulls together."""
    sums = frame.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.sum("error").alias(total))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return frame.join(sums, F.col(f"`{label}`").eqNullSafe(F.col("_label")), "left").drop("_label")
