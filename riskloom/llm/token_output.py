"""Token-id output in a binary format: Simple-8b words with escapes and offsets of blocks.

A frame is a self-contained piece of the format and holds the ids of up to a bounded number of tokens of successive documents (a
document that is longer has a frame of its own):

    magic "RL8B", version, documents, ids, words, escapes, blocks (u4 each)
    document lengths (u4 each) | block offsets: first word, first escape of each block (u4 pairs) | words (u8) | escapes (u4)

Each 64-bit word has a selector in its top 4 bits, which says how many ids of how many bits fill the other 60; it takes as many of the next
ids as fit. Ids are below 2**32. Those that no selector holds (above IN_PLACE) are the escape value of 0 plus an entry in the escapes. A block
is BLOCK ids (the last: what is left); it starts at a word of its own, so blocks decode by themselves, and within a frame all words of
a selector decode at once in numpy.

Null and empty texts have just the end id. Texts of any length are encoded whole. Rows are in ascending order of doc_id, null last; those
that share a doc_id are documents of their own, in the order of a hash of their texts. Ranges of rows are cut in the order (doc_id, hash, place
in the input), so rows that share a doc_id, or are alike, spread over tasks. An empty table gives no frames and an empty result; extra columns
are never read. Frames are stored by Spark in Parquet (a binary column, beside it the doc_ids and numbers of ids), so that any file system
that Spark writes to will do and a lost task's files are never seen; dump() and load() put the same bytes in plain files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions, scratch_path, text_of
from .tokens import encoder

END_ID = 1
#: Ids in a block, and ids after which a frame is closed.
BLOCK, FRAME = 1 << 14, 1 << 18
#: selector -> (ids in a word, bits of each)
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20))
#: The largest id that is stored in place. Larger ones are escapes: a 0 in place (0 itself is stored as 1, and so on) and the id beside. With
#: a smaller limit, ids that fit a wide selector would take 32 bits beside and a place.
IN_PLACE = (1 << 20) - 2
_BITS = np.frexp(np.arange(1 << 20))[1].astype(np.int8)
_COUNTS = np.array([c for c, _ in WIDTHS])
VERSION = 2
HEAD = struct.Struct("<4sIIIIII")


def pack_words(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of values (uint64, below 2**20): each word takes as many of the next values as fit.

    A selector's word may start where its number of values in a row fit, and anywhere after the last value that is too wide for it. So the
    words are found by one pass over their starts, and filled selector by selector.
    """
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    bits = _BITS[values.astype(np.int32)]
    best = np.full(n, len(WIDTHS) - 1, np.int8)
    for s in range(len(WIDTHS) - 2, -1, -1):
        count, width = WIDTHS[s]
        fits = bits <= width
        at = np.flatnonzero(fits)
        best[at[: len(at) - count + 1][at[count - 1 :] - at[: len(at) - count + 1] == count - 1] if len(at) >= count else at[:0]] = s
        # From here on all values fit.
        best[n - int(fits[::-1].argmin()) if len(at) < n else 0 :] = s
    # Where words start is found by doubling: the starts so far, and those that as many words further on follow them. n stands for the end.
    after = np.append(np.minimum(np.arange(n) + _COUNTS[best], n), n)
    starts = np.zeros(1, np.int64)
    while (more := after[starts])[0] < n:
        starts = np.concatenate([starts, more])
        after = after[after]
    starts = np.concatenate([starts, more])
    starts = starts[starts < n]
    chosen = best[starts]
    # Zeros fill up the last word.
    padded = np.concatenate([values, np.zeros(64, np.uint64)])
    out = np.zeros(len(starts), np.uint64)
    for s in np.unique(chosen):
        count, width = WIDTHS[s]
        rows = np.flatnonzero(chosen == s)
        word = np.full(len(rows), np.uint64(s) << np.uint64(60))
        grid = padded[starts[rows][:, None] + np.arange(count)]
        for k in range(count):
            word |= grid[:, k] << np.uint64(width * k)
        out[rows] = word
    return out


def unpack_words(words: np.ndarray) -> np.ndarray:
    """All values of the words, with the zeros that fill up a last word."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selector]
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(first[-1]), np.uint64)
    for s in np.unique(selector):
        count, width = WIDTHS[s]
        rows = np.flatnonzero(selector == s)
        shifts = (np.arange(count) * width).astype(np.uint64)
        out[(first[rows][:, None] + np.arange(count)).ravel()] = ((words[rows][:, None] >> shifts) & np.uint64((1 << width) - 1)).ravel()
    return out


def encode_frame(docs: list[np.ndarray]) -> bytes:
    lengths = np.array([len(d) for d in docs], "<u4")
    ids = np.concatenate(docs).astype(np.uint64) if docs else np.empty(0, np.uint64)
    words, offsets, escapes = [], [], []
    n_words = n_escapes = 0
    for i in range(0, len(ids), BLOCK):
        block = ids[i : i + BLOCK]
        far = block > IN_PLACE
        offsets += [n_words, n_escapes]
        w = pack_words(np.where(far, np.uint64(0), block + np.uint64(1)))
        words.append(w)
        escapes.append(block[far].astype("<u4"))
        n_words += len(w)
        n_escapes += len(escapes[-1])
    head = HEAD.pack(b"RL8B", VERSION, len(docs), len(ids), n_words, n_escapes, len(offsets) // 2)
    return b"".join([head, lengths.tobytes(), np.array(offsets, "<u4").tobytes(), *(w.astype("<u8").tobytes() for w in words), *(e.tobytes() for e in escapes)])


def decode_frame(data: bytes) -> list[np.ndarray]:
    """The ids (uint32) of each document of a frame."""
    magic, version, n_docs, n_ids, n_words, n_escapes, n_blocks = HEAD.unpack_from(data)
    if magic != b"RL8B" or version != VERSION:
        raise ValueError("not a frame of this format")
    at = HEAD.size
    lengths = np.frombuffer(data, "<u4", n_docs, at)
    at += 4 * n_docs
    offsets = np.frombuffer(data, "<u4", 2 * n_blocks, at).reshape(-1, 2).astype(np.int64)
    at += 8 * n_blocks
    words = np.frombuffer(data, "<u8", n_words, at)
    escapes = np.frombuffer(data, "<u4", n_escapes, at + 8 * n_words)
    values = unpack_words(words)
    # Values before each block: all those of the words before it. The last word of a block may be filled up with zeros.
    counts = _COUNTS[(words >> np.uint64(60)).astype(np.int64)] if n_words else np.empty(0, np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.full(n_blocks, BLOCK)
    if n_blocks:
        sizes[-1] = n_ids - BLOCK * (n_blocks - 1)
    keep = np.repeat(before[offsets[:, 0]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n_blocks else np.empty(0, np.int64), sizes) + np.arange(n_ids)
    got = values[keep]
    ids = (got - np.uint64(1)).astype(np.uint32)
    ids[got == 0] = escapes
    return np.split(ids, np.cumsum(lengths)[:-1].astype(np.int64)) if n_docs else []


def decode_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, without decoding what stands before it."""
    _, _, n_docs, n_ids, n_words, n_escapes, n_blocks = HEAD.unpack_from(data)
    at = HEAD.size + 4 * n_docs
    offsets = np.frombuffer(data, "<u4", 2 * n_blocks, at).reshape(-1, 2)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * n_blocks)
    escapes = np.frombuffer(data, "<u4", n_escapes, at + 8 * n_blocks + 8 * n_words)
    w0, e0 = (int(x) for x in offsets[block])
    w1, e1 = (int(x) for x in offsets[block + 1]) if block + 1 < n_blocks else (n_words, n_escapes)
    got = unpack_words(words[w0:w1])[: min(BLOCK, n_ids - BLOCK * block)]
    ids = (got - np.uint64(1)).astype(np.uint32)
    ids[got == 0] = escapes[e0:e1]
    return ids


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode docs (doc_id, text) and write their frames in ascending doc_id order: files by range, frames by number in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        no = 0

        def frame() -> pa.RecordBatch:
            nonlocal held, ids, no
            out = pa.RecordBatch.from_pydict({"part": [part], "frame_no": [no], "doc_ids": [ids], "n_ids": [sum(map(len, held))], "frame": [encode_frame(held)]}, schema=pa.schema([("part", pa.int32()), ("frame_no", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("frame", pa.binary())]))
            held, ids, no = [], [], no + 1
            return out

        size = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                for d, x in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist()), strict=True):
                    if held and size + len(x) + 1 > FRAME:
                        yield frame()
                        size = 0
                    held.append(np.append(x, np.uint32(END_ID)))
                    ids.append(d)
                    size += len(x) + 1
        if held:
            yield frame()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("row")]
    # The ranges' limits come from a sample of these three columns, which the driver gets.
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    out = rows.mapInArrow(run, "part int, frame_no bigint, doc_ids array<bigint>, n_ids bigint, frame binary")
    # Frames hardly compress; the doc_ids beside them do.
    out.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files, by decoding each frame.

    What is broadcast has a row for each file: the ids before it.
    """
    frames = spark.read.parquet(path)
    along = W.partitionBy("part").orderBy("frame_no").rowsBetween(W.unboundedPreceding, -1)
    counts = frames.select("part", "frame_no", "n_ids")
    inside = counts.withColumn("in_part", F.coalesce(F.sum("n_ids").over(along), F.lit(0))).drop("n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("frame_no", pa.int64()), ("doc_id", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for r in range(b.num_rows):
                part, no, doc_ids, data = (b.column(k)[r].as_py() for k in range(4))
                docs = decode_frame(data)
                sizes = [len(d) for d in docs]
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"part": [part] * len(docs), "frame_no": [no] * len(docs), "doc_id": doc_ids, "inner": starts, "n_tokens": sizes, "ids_crc32": [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]}, schema=schema)

    rows = frames.select("part", "frame_no", "doc_ids", "frame").mapInArrow(run, "part int, frame_no bigint, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    rows = rows.join(inside, ["part", "frame_no"]).join(F.broadcast(parts), "part")
    return rows.select("doc_id", (F.col("before") + F.col("in_part") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def dump(frames: list[bytes], path: str) -> None:
    """Frames in a plain file, each after its length (u8)."""
    with open(path, "wb") as f:
        for x in frames:
            f.write(struct.pack("<Q", len(x)) + x)


def load(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        data, at, out = f.read(), 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def query(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or scratch_path(spark, "token-files")
    write(docs, path)
    return read(spark, path)
