"""Best-fit packing of documents into sequences, certified by lower bounds.

Pieces (documents, cut only where they are longer than a sequence) are dealt by hash over partitions of a bounded number of pieces.
Each partition is packed by best-fit decreasing, and dual-feasible functions give a lower bound on the sequences that its pieces
need. A partition that meets its bound is certified and passes on only the one sequence that is filled least; the others pass on the
pieces of each sequence with a gap. What was passed on is dealt anew over fewer partitions and packed again, until one partition
holds it. Rounds only ever merge gaps, so the count never grows. `certified` says of a sequence that it is full, or that the partition that
packed it last met its bound.

Null and empty texts are a document of the end id alone; texts of any length are cut as often as they need. Rows that repeat are packed as
often as they stand there: a piece is dealt by its row's place in the input too, so that pieces that are alike spread over partitions. Of
pieces of one length the lesser doc_id comes first. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, text_of
from .tokens import encoder

CAPACITY, END_ID = 2048, 0
#: Pieces of a partition on the average: a task holds this many rows of 60 bytes, whatever the input.
PART_PIECES = 4000
#: Partitions become fewer by this factor with each round.
SHRINK = 4
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, mark bigint"
PACKED = PIECE + ", sequence_id bigint, offset bigint, final boolean, certified boolean"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each document; mark is a hash by which pieces are dealt, of its content and its place in the input."""

    def make():
        from pyspark import TaskContext

        enc, part, rows = encoder(vocabulary), TaskContext.get().partitionId(), itertools.count()

        def f(c):
            out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "mark")}
            for d, x in zip(c["doc_id"], enc.ids(c["text"]), strict=True):
                x, row = np.append(x, np.uint32(end_id)).astype("<u4"), next(rows)
                for k in range(0, len(x), capacity):
                    cut = x[k : k + capacity]
                    crc = zlib.crc32(cut.tobytes())
                    for n, v in (("doc_id", d), ("piece", k // capacity), ("start", k), ("length", len(cut)), ("ids_crc32", crc), ("mark", zlib.crc32(f"{part}:{row}:{k}:{crc}".encode()))):
                        out[n].append(v)
            return out

        return f

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), make, PIECE, 2048)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length. The longest come first; each goes to the fullest bin that has room.

    Bins are kept by the room they have; an integer has a bit for each room that some bin has, so the smallest room that
    suffices is found by a shift.
    """
    bins = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        high = bits >> size
        if high:
            room = size + (high & -high).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                bits &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        left = room - size
        if left:
            rooms[left].append(b)
            bits |= 1 << left
    return bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions. counts[x] pieces have length x (0 to capacity).

    f_k(x): x > capacity - k counts as capacity, x < k as 0, others as x; for k up to half of the capacity.
    u_m(x): x (m + 1) / capacity if that is whole, else floor(x (m + 1) / capacity) / m in units of the capacity.
    """
    x = np.arange(capacity + 1)
    best = -(-int((counts * x).sum()) // capacity)
    number, mass = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]]), np.concatenate([[0], np.cumsum(counts * x)])
    for k in range(1, capacity // 2 + 1):
        large = int(number[capacity - k + 1])
        middle = int(mass[capacity - k + 1] - mass[k])
        best = max(best, large + -(-middle // capacity))
    for m in range(1, 21):
        whole, rest = np.divmod(x * (m + 1), capacity)
        scaled = np.where(rest == 0, x * m, whole * capacity)  # in units of 1 / (capacity * m)
        best = max(best, -(-int((counts * scaled).sum()) // (capacity * m)))
    return best


def _pack_part(capacity: int, level: int, last: bool):
    def f(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t.column("length").to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        final = np.ones(len(fill), bool)
        met = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if not last:
            if met:
                least = int(fill.argmin())
                final[least] = fill[least] == capacity
            else:
                final = fill == capacity
        order = np.argsort(bins, kind="stable")
        offset = np.empty(len(lengths), np.int64)
        run = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(bins[order], np.arange(len(fill)))
        offset[order] = run - run[first][bins[order]]
        number = (np.int64(level) << 58) + (np.int64(key[0].as_py()) << 32) + bins
        return t.drop_columns(["part"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("final", pa.array(final[bins])).append_column("certified", pa.array((met | (fill == capacity))[bins]))

    return f


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, part_pieces: int = PART_PIECES) -> DataFrame:
    left = stored(pieces(docs, capacity, end_id, vocabulary), "pieces")
    count = left.count()
    parts = max(1, -(-count // part_pieces))
    done = None
    # Partitions become fewer with each round, so this ends.
    for level in itertools.count():
        last = parts == 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64("mark", F.lit(level)), F.lit(parts)))
        packed = stored(dealt.groupBy("part").applyInArrow(_pack_part(capacity, level, last), PACKED), f"packed-{level}")
        part = packed.where("final").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        left = packed.where("NOT final").select(*[x.split()[0] for x in PIECE.split(", ")])
        count = left.count()
        parts = max(1, min(-(-parts // SHRINK), -(-count // part_pieces)))
    return done


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences of a packing, and a lower bound on those of any. Only the counts of the lengths (capacity + 1 at most) reach the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
