"""Best-fit packing of documents into token sequences, with certified bin counts.

Documents become token ids; those longer than a sequence are cut into whole sequences and a rest.  The pieces
are dealt into buckets of bounded size, each packed by best fit decreasing.  Dual feasible functions give a
lower bound of the number of sequences a bucket needs.  A bucket that reaches its bound is certified and gives
back only its emptiest sequence; a bucket with a gap gives back all sequences with room.  What was given back is
dealt anew, by another salt, into as many buckets as their size asks for and packed again, until all that is open
fits into one bucket, or reaches its common bound, or a round no longer saves a sequence (then the sequences before
it stand).  So no group grows with the data, however many pieces come back.

Each round reads and writes (row, length) tables only; ids never move after the first scan.  The driver gets
counts of lengths (as many rows as a sequence has tokens) and nothing else.

Defined cases: a null or empty text has only its end token; equal or null document ids are packed piece by piece
like any others; an empty table gives no rows; a length above the sequence length can't occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolens.llm.tokens import token_bytes
from geolens.llm.words import chunks
from geolens.session import cut_lineage

LENGTH = 4096
END_ID = 1
TEXT_BYTES = 2 << 20  # tokenised at once
ROWS_PER_BUCKET = 10_000
BINS = 1 << 20  # of a bucket, as a sequence number has 20 bits for them


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", doc: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]): ids of whole texts with an end id, cut at ``length``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                owner, piece, start, size, crc, own = [], [], [], [], [], []
                for i, data in enumerate(token_bytes(part.column("text"), tokenizer)):
                    data += end
                    for k, a in enumerate(range(0, len(data), 4 * length)):
                        ids = data[a : a + 4 * length]
                        owner.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        size.append(len(ids) // 4)
                        crc.append(zlib.crc32(ids))
                        if with_ids:
                            own.append(np.frombuffer(ids, "<u4").astype(np.int32))
                columns = [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return plain.mapInArrow(cut, schema).select(F.monotonically_increasing_id().alias("row"), "*")


def lower_bound(counts: np.ndarray, length: int = LENGTH) -> int:
    """Sequences that pieces need at least; ``counts[s]`` is the number of pieces of ``s`` tokens.

    The maximum over two families of dual feasible functions: the threshold functions, which lift pieces above
    ``length - a`` to a whole sequence and drop those below ``a``, and the rounding functions of parameter k.
    """
    size = np.flatnonzero(counts)
    n = counts[size].astype(np.int64)
    if not len(size):
        return 0
    best = -(-int((size * n).sum()) // length)
    thresholds = np.unique(np.concatenate((size[size <= length // 2], length - size[size > length // 2] + 1)))
    for a in thresholds[(thresholds > 0) & (thresholds <= length // 2)]:
        lifted = np.where(size > length - a, length, np.where(size >= a, size, 0))
        best = max(best, -(-int((lifted * n).sum()) // length))
    for k in range(1, 65):  # in units of 1 / (k * length)
        scaled = (k + 1) * size
        value = np.where(scaled % length == 0, size * k, scaled // length * length)
        best = max(best, -(-int((value * n).sum()) // (k * length)))
    return best


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin; ``sizes`` are in decreasing order."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for i, s in enumerate(sizes.tolist()):
        fitting = rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = length, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if room > s:
            by_room[room - s].append(b)
            rooms |= 1 << (room - s)
    return bins, offsets, np.array(fill, np.int64)


_PLACED = "row long, length long, bucket long, bin long, offset long, stays boolean"


def _pack(open_: DataFrame, buckets: int, round_: int, length: int, last: bool) -> DataFrame:
    """One round: (row, length, bucket, bin, offset, stays)."""

    def pack(group: pa.Table) -> pa.Table:
        row, size = group["row"].to_numpy(), group["length"].to_numpy()
        order = np.lexsort((row, -size))
        row, size = row[order], size[order]
        bins, offsets, fill = best_fit_decreasing(size, length)
        if len(fill) > BINS:
            raise ValueError(f"a bucket has {len(fill)} sequences; use fewer rows in a bucket")
        stays = fill == length
        if last:
            stays[:] = True
        elif len(fill) == lower_bound(np.bincount(size, minlength=length + 1), length):
            stays[:] = True
            stays[np.argmin(fill)] = fill.min() == length
        bucket = np.full(len(row), group["bucket"][0].as_py())
        return pa.table({"row": row, "length": size, "bucket": bucket, "bin": bins, "offset": offsets, "stays": stays[bins]})

    dealt = open_.select("row", "length", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(pack, _PLACED)


def _bound(open_: DataFrame, length: int) -> int:
    counts = np.zeros(length + 1, np.int64)
    for r in open_.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return lower_bound(counts, length)


def place(written: DataFrame, length: int = LENGTH, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(row, sequence_id, offset) for a written table of (row, length)."""
    whole = written.filter(F.col("length") == length).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [whole]
    open_ = written.filter(F.col("length") < length).select("row", "length")
    n, number, before = open_.count(), 0, None

    def name(df: DataFrame, round_: int) -> DataFrame:
        """Numbers of 7 bits for the round, 36 for the bucket and 20 for the bin in it."""
        number = F.shiftleft(F.lit(round_).cast("long"), 56) + F.shiftleft("bucket", 20) + F.col("bin")
        return df.select("row", number.alias("sequence_id"), "offset")

    while n:
        number += 1
        buckets = -(-n // rows_per_bucket)
        bound = _bound(open_, length)
        if before is not None and before[1] == bound:  # the open sequences are certified as they stand
            placed.append(name(before[0], number - 1))
            break
        packed = cut_lineage(_pack(open_, buckets, number, length, last=buckets == 1))
        used = packed.select("bucket", "bin").distinct().count()
        if before is not None and used >= before[1]:
            placed.append(name(before[0], number - 1))
            break
        placed.append(name(packed.filter("stays"), number))
        returned = packed.filter("not stays")
        n = returned.count()
        before = returned, returned.select("bucket", "bin").distinct().count()
        open_ = returned.select("row", "length")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", doc: str = "doc_id", with_ids: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    written = cut_lineage(pieces(docs, tokenizer, length, end_id, text, doc, with_ids))
    return written.join(place(written.select("row", "length"), length, rows_per_bucket), "row").drop("row")
