"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Texts that have the same words in lower case are one node (128 bits of hash). A node's shingles are its runs of WIDTH words (64 bits of hash
each). A shingle that stands n times in a text and in d of N documents weighs

    (1 + ln n) * sqrt(idf(d) / idf(1)),   idf(d) = 1 + ln((1 + N) / (1 + d)).

The root damps the inverse document frequency as the logarithm damps the term frequency: without it a large group of near copies lowers
its own similarity. Document frequencies are counted over all documents in COUNTERS counters by hash, from which the median, what chance
collisions add, is taken off; a counter within five standard deviations of the median counts as 1 (and so do shingles that stand in fewer
documents than that). Weights are kept to 1 / 255.

BANDS bands of ROWS samples each put nodes in buckets, and two nodes are a candidate pair if they share a bucket. Two nodes are linked if
their weighted Jaccard similarity is at least SIMILARITY; classes are the connected components. Pairs of which fewer than LEAST of all
BANDS * ROWS samples agree aren't verified: at a similarity of 0.8 that befalls one pair in 10^11, where bands miss one in 2500.

No bucket's pairs are listed. First every node is verified against the first node of each of its buckets, and links make components. Then
only nodes whose component differs from their bucket's first node's are left over; blocks of them are held against the rest of their bucket,
first by their samples and then, for those with a pair that agrees enough, by their texts; only links between components come out. So each
candidate pair is verified or in one component already: no link is lost, and there is no cap. What is held together is dealt by (first node,
part of 256 partners) and (bucket, block, part), so a first node with many partners, or a bucket with many rows, is spread over tasks.

Null counts as empty; texts without a word are one class, and texts with fewer than WIDTH words have one shingle of all of them. Texts of any
length are read whole, in as many blocks of shingles as they need. Of rows that tie (same text, same doc_id) the first in the order of the
input's partitions stays. Rows that repeat are in their class as often as they stand there. A class's id is its least doc_id, null last. An
empty table gives an empty result; extra columns are never read, whatever their names and types.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot, join_spread, keep_rows, partitions, sieve, stored, text_of
from .sampling import Sampler, bags, bags_of, mixed, slices, words_of

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 20, 5, 23
#: The share of samples that must agree for a candidate pair to be verified.
LEAST = 0.5
#: Counters of the document frequency table, and how many of them go in one message.
COUNTERS, CHUNK = 1 << 22, 1 << 18
#: Partners of a first node that are verified by one task at a time.
PARTNERS = 256
#: Left-over nodes in a block, and rows of their bucket that one task holds against it.
BLOCK, AGAINST = 256, 1024

Bag = tuple[np.ndarray, np.ndarray]


def marks() -> list[Column]:
    """Two hashes of a row's doc_id and text, by which rows are met again in the input."""
    doc_id = F.col("doc_id").cast("bigint")
    return [F.xxhash64(doc_id, text_of()).alias("mark"), F.xxhash64(text_of(), doc_id, F.lit(1)).alias("mark2")]


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


# Document frequencies.


def _message(part: int, chunk: int, counts: np.ndarray) -> pa.RecordBatch:
    data = zlib.compress(counts.astype("<u4").tobytes(), 1)
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "data": pa.array([data], pa.binary())})


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    counts = np.zeros(COUNTERS, np.uint32)
    for whole in batches:
        for i, j in slices(whole.column(0)):
            terms, _, _ = bags(lower(whole.column(0).slice(i, j - i)), WIDTH)
            np.add.at(counts, (terms & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
    for k in range(0, COUNTERS, CHUNK):
        if counts[k : k + CHUNK].any():
            yield _message(TaskContext.get().partitionId(), k // CHUNK, counts[k : k + CHUNK])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages come one by one: a task holds one sum of the table at most, however many tasks counted."""
    from pyspark import TaskContext

    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            sums.setdefault(chunk, np.zeros(CHUNK, np.uint32))
            sums[chunk] += _counts(data.as_buffer())
    for chunk, x in sums.items():
        yield _message(TaskContext.get().partitionId(), chunk, x)


def frequencies(texts: DataFrame) -> np.ndarray:
    """The counters over all of texts (text): 16 MB, whatever the input."""
    schema = "part int, chunk int, data binary"
    parts = texts.select("text").mapInArrow(_count, schema)
    # Two steps: first each task's share of all messages, then those of a chunk, of which there are no more than partitions.
    parts = parts.repartition(partitions(texts.sparkSession), "part", "chunk").mapInArrow(_add, schema)
    parts = parts.repartition(COUNTERS // CHUNK, "chunk").mapInArrow(_add, schema)
    counts = np.zeros(COUNTERS, np.uint32)
    for r in parts.collect():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = _counts(bytes(r["data"]))
    return counts


def levels_of(counts: np.ndarray, documents: int) -> np.ndarray:
    """255 times the root of idf(d) / idf(1), for each counter: 4 MB."""
    chance = float(np.partition(counts, len(counts) // 2)[len(counts) // 2])
    idf = lambda d: 1 + np.log((1 + documents) / (1 + d))
    out = np.zeros(len(counts), np.uint8)
    for k in range(0, len(counts), CHUNK):
        part = counts[k : k + CHUNK].astype(np.float64)
        d = np.where(part > chance + 5 * np.sqrt(chance), part - chance, 1).clip(1)
        out[k : k + CHUNK] = np.round(255 * np.sqrt(np.maximum(idf(d), 0) / max(idf(1), 1e-9))).clip(1, 255)
    return out


def weights_of(terms: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * (levels[(terms & np.uint64(COUNTERS - 1)).astype(np.int64)] / 255.0)


# Samples and similarities.


def bands_of(samples: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's samples, a row for each text."""
    grouped = samples.reshape(len(samples), BANDS, ROWS)
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(samples), 0)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return out.view(np.int64)


def similarity(a: Bag, b: Bag) -> float:
    """Weighted Jaccard similarity of (terms, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both) if both else 0.0


def weighed(texts: pa.Array, levels: np.ndarray) -> Iterator[Bag]:
    for i, j in slices(texts):
        terms, counts, starts = bags(lower(texts.slice(i, j - i)), WIDTH)
        weights = weights_of(terms, counts, levels)
        yield from ((terms[a:b], weights[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _signatures(column: pa.Array) -> np.ndarray:
    """Binary signatures as rows of 16-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), BANDS * ROWS)


def _sign(levels: Broadcast):
    """Of (doc_id, row, mark, mark2, text): the same but for the text, and node, bands, sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sampler = Sampler(BANDS * ROWS, SEED)
        for whole in batches:
            for i, j in slices(whole.column(4)):
                b = whole.slice(i, j - i)
                h, begin = words_of(lower(b.column(4)))
                nodes = pa.array([xxhash.xxh3_128_digest(h[x:y].tobytes()) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())
                terms, counts, starts = bags_of(h, begin, WIDTH)
                samples = sampler.sample(terms, weights_of(terms, counts, levels.value), starts)
                some = np.diff(starts) > 0
                flat = pa.array(bands_of(samples)[some].ravel(), pa.int64())
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), flat)
                signs = pa.array([x.tobytes() for x in (samples >> np.uint64(48)).astype("<u2")], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], nodes, bands, signs], names=["doc_id", "row", "mark", "mark2", "node", "bands", "sign"])

    return run


# Verification.


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (k, first, sign, first_sign): the pairs (k, first) that agree enough."""
    for b in batches:
        ok = agreement(_signatures(b.column(2)), _signatures(b.column(3))) >= LEAST if b.num_rows else np.zeros(0, bool)
        yield b.select(["k", "first"]).filter(pa.array(ok, pa.bool_()))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k, text) for nodes (k, mark, mark2). Rows of docs that repeat are met once."""
    met = sieve(docs.select(*marks(), text_of().alias("text")), "mark", nodes, "mark")
    return met.groupBy("mark", "mark2").agg(F.first("text").alias("text")).join(nodes.hint("merge"), ["mark", "mark2"]).select("k", "text")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, levels: Broadcast, scratch: Scratch) -> DataFrame:
    """The pairs (k, first) that are linked."""
    sizes = scratch.stored(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n")), "pair-sizes")
    dealt = join_hot(pairs, sizes, "first", "n", pairs.count())
    dealt = scratch.stored(dealt.select("k", "first", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / PARTNERS)).cast("int").alias("part")), "pairs-dealt")
    partners = dealt.select("k", "first", "part", F.lit(1).alias("role"))
    wants = scratch.stored(partners.unionByName(dealt.select(F.col("first").alias("k"), "first", "part", F.lit(0).alias("role")).distinct()), "pair-wants")
    texts = texts_of(docs, nodes.select("k", "mark", "mark2").join(wants.select("k").distinct(), "k", "left_semi"))
    met = wants.join(scratch.stored(texts, "pair-texts").hint("merge"), "k").select("first", "part", "role", "k", "text")
    met = met.repartition(partitions(docs.sparkSession), "first", "part").sortWithinPartitions("first", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for b in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for first, part, role, k, bag in zip(*(c.to_pylist() for c in b.columns[:4]), weighed(b.column(4), levels.value), strict=True):
                if role == 0:
                    group, own = (first, part), bag
                elif group == (first, part) and similarity(own, bag) >= SIMILARITY:
                    out[0].append(k)
                    out[1].append(first)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["k", "first"])

    return scratch.stored(met.mapInArrow(run, "k bigint, first bigint"), "verified")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (of all that are connected, one node) for the nodes of edges (a, b).

    Each round takes every node to its least neighbour (or itself), and edges to those; what is left has at most half the nodes that
    aren't the least of their component. A node with many edges, or a label of many nodes, is spread over tasks.
    """
    labels, round_ = None, 0
    edges = scratch.stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = scratch.stored(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), f"least-{round_}")
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            # Labels that no edge is left of stay as they are.
            every = labels.select(F.col("label").alias("a")).distinct().join(to.hint("merge"), "a", "left").select("a", F.coalesce("to", "a").alias("to"))
            moved = join_spread(labels.withColumnRenamed("label", "a"), scratch.stored(every, f"moves-{round_}"), "a")
            labels = scratch.stored(moved.select("node", F.col("to").alias("label")), f"labels-{round_}")
        ends = join_spread(edges, to, "a").select(F.col("to").alias("new_a"), "b")
        ends = join_spread(ends, to.withColumnRenamed("a", "b"), "b", like=edges).select(F.col("new_a").alias("a"), F.col("to").alias("b"))
        edges = scratch.stored(ends.where("a <> b").distinct(), f"edges-{round_}")
        round_ += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, mark, node), one for each of docs, and nodes (node, n, id, k, class_id, class_k, class_size); k is the row of a node's least doc_id."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    total = docs.count()
    levels = spark.sparkContext.broadcast(levels_of(frequencies(docs.select(text_of().alias("text"))), total))
    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), *marks(), text_of().alias("text"))
    signed = stored(numbered.mapInArrow(_sign(levels), "doc_id bigint, row bigint, mark bigint, mark2 bigint, node binary, bands array<bigint>, sign binary"), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "mark", "mark2")).alias("f")
    nodes = signed.groupBy("node").agg(least, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sign").alias("sign"))
    nodes = scratch.stored(nodes.select(F.col("f.row").alias("k"), "node", F.col("f.doc_id").alias("id"), "f.mark", "f.mark2", "n", "bands", "sign"), "nodes")
    rows = nodes.select(F.explode("bands").alias("band"), "k")
    firsts = scratch.stored(rows.groupBy("band").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "firsts")
    met = scratch.stored(join_hot(rows, firsts, "band", "c", total), "buckets")
    pairs = scratch.stored(met.where("k <> first").select("k", "first").distinct(), "pairs")
    signs = nodes.select("k", "sign")
    pairs = join_spread(pairs, signs.select(F.col("k").alias("first"), F.col("sign").alias("first_sign")), "first").join(signs, "k")
    pairs = scratch.stored(pairs.select("k", "first", "sign", "first_sign").mapInArrow(_agree, "k bigint, first bigint"), "pairs-agreeing")
    linked = verify(docs, nodes, pairs, levels, scratch)
    labels = components(linked.select(F.col("k").alias("a"), F.col("first").alias("b")), scratch)
    labels = _rest(docs, nodes, met, firsts, labels, levels, scratch)
    whole = nodes.select("node", "n", "id", "k").join(labels.withColumnRenamed("node", "k"), "k", "left")
    whole = scratch.stored(whole.select("node", "n", "id", "k", F.coalesce("label", "k").alias("label")), "node-labels")
    by = whole.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("f"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("c"))
    by = scratch.stored(by.select("label", F.col("f.id").alias("class_id"), F.col("f.k").alias("class_k"), "class_size", "c"), "classes")
    out = stored(join_hot(whole, by, "label", "c", total).drop("c", "label"), "node-classes")
    scratch.drop()
    levels.unpersist()
    return signed.select("doc_id", "row", "mark", "node"), out


def _rest(docs: DataFrame, nodes: DataFrame, met: DataFrame, firsts: DataFrame, labels: DataFrame, levels: Broadcast, scratch: Scratch) -> DataFrame:
    """labels after those nodes that share a bucket but not a component are held against each other."""
    spark = docs.sparkSession
    # A node is in BANDS buckets at most, also as their first one, so no key of these joins is hot.
    part = met.select("band", "k").join(labels.withColumnRenamed("node", "k"), "k", "left").select("band", "k", F.coalesce("label", "k").alias("label"))
    heads = firsts.withColumnRenamed("first", "k").join(labels.withColumnRenamed("node", "k"), "k", "left").select("band", "c", F.col("k").alias("first"), F.coalesce("label", "k").alias("first_label"))
    part = scratch.stored(join_hot(scratch.stored(part, "bucket-labels"), scratch.stored(heads, "first-labels"), "band", "c", met.count()), "left-over")
    outside = F.col("label") != F.col("first_label")
    # The first ones have been met by all.
    part = part.where("k <> first").drop("first")
    sizes = scratch.stored(part.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("o")).where("o > 0 AND n > 1"), "left-sizes")
    if sizes.isEmpty():
        return labels
    rows = join_hot(part.drop("c"), sizes, "band", "n", part.count())
    rows = scratch.stored(rows.join(nodes.select("k", "sign"), "k"), "left-rows")
    blocks, parts = F.ceil(F.col("o") / BLOCK), F.ceil(F.col("n") / AGAINST)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    held = rows.where(outside).select("band", F.pmod(F.xxhash64("k", F.lit(1)), blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("role"), "k", "label", "sign")
    others = rows.select("band", F.pmod(F.xxhash64("k"), parts).alias("part"), every(blocks).alias("block"), F.lit(1).alias("role"), "k", "label", "sign")
    cell = ["band", "block", "part"]
    dealt = held.unionByName(others).repartition(partitions(spark), *cell).sortWithinPartitions(*cell, "role", "k")
    schema = "band bigint, block bigint, part bigint, role int, k bigint, label bigint, sign binary"
    near = scratch.stored(dealt.mapInArrow(_by_cell(_agreeing), schema), "left-agreeing")
    texts = texts_of(docs, nodes.select("k", "mark", "mark2").join(near.select("k").distinct(), "k", "left_semi"))
    again = near.join(scratch.stored(texts, "left-texts").hint("merge"), "k").select(*cell, "role", "k", "label", "sign", "text")
    again = again.repartition(partitions(spark), *cell).sortWithinPartitions(*cell, "role", "k")
    links = scratch.stored(again.mapInArrow(_by_cell(_linking(levels)), "a bigint, b bigint").distinct(), "left-links")
    to = components(links, scratch).select(F.col("node").alias("at"), F.col("label").alias("to"))
    # Labels without an entry of their own are nodes that had no link so far.
    moved = scratch.stored(labels.select(F.col("label").alias("at")).distinct().join(to.hint("merge"), "at", "left").select("at", F.coalesce("to", "at").alias("to")), "left-moves")
    old = join_spread(labels.withColumnRenamed("label", "at"), moved, "at").select("node", F.col("to").alias("label"))
    new = to.join(labels.select(F.col("node").alias("at")), "at", "left_anti").select(F.col("at").alias("node"), F.col("to").alias("label"))
    return scratch.stored(old.unionByName(new), "labels-all")


def _by_cell(held):
    """Rows (band, block, part, role, k, label, sign ...), in order of their cells: held(cell's own rows, a run of the rows they are held against) makes a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own, other = None, [], []
        for b in batches:
            for i, j in slices(b.column(b.num_columns - 1)):
                for row in zip(*(c.to_pylist() for c in b.slice(i, j - i).columns), strict=True):
                    if row[:3] != cell:
                        if own and other:
                            yield held(own, other)
                        cell, own, other = row[:3], [], []
                    (other if row[3] else own).append(row)
                    if len(other) == 2 * AGAINST:
                        yield held(own, other)
                        other = []
        if own and other:
            yield held(own, other)

    return run


def _pairs(own: list[tuple], other: list[tuple]) -> np.ndarray:
    """Which rows of own and other have different labels and samples that agree enough."""
    signs = [np.frombuffer(b"".join(r[6] for r in x), "<u2").reshape(len(x), -1) for x in (own, other)]
    labels = [np.array([r[5] for r in x]) for x in (own, other)]
    near = np.stack([agreement(s, signs[1]) >= LEAST for s in signs[0]]) if len(own) > 1 else (agreement(signs[0], signs[1]) >= LEAST)[None]
    return near & (labels[0][:, None] != labels[1])


def _agreeing(own: list[tuple], other: list[tuple]) -> pa.RecordBatch:
    """The rows that have a pair."""
    near = _pairs(own, other)
    rows = [r for r, ok in zip(own, near.any(1).tolist(), strict=True) if ok] + [r for r, ok in zip(other, near.any(0).tolist(), strict=True) if ok]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["band", "block", "part", "role", "k", "label", "sign"])


def _linking(levels: Broadcast):
    """The labels (a, b) that pairs of linked rows join; a pair of labels that the cell's links have joined already isn't looked at again."""

    def held(own: list[tuple], other: list[tuple]) -> pa.RecordBatch:
        known: dict[int, int] = {}

        def root(x: int) -> int:
            while known.get(x, x) != x:
                x = known[x]
            return x

        pairs, out = np.nonzero(_pairs(own, other)), []
        texts = {r[4]: r[7] for r in (*(own[i] for i in set(pairs[0].tolist())), *(other[j] for j in set(pairs[1].tolist())))}
        bag = dict(zip(texts, weighed(pa.array(list(texts.values()), pa.large_string()), levels.value), strict=True))
        for i, j in zip(*(x.tolist() for x in pairs), strict=True):
            a, b = own[i], other[j]
            if root(a[5]) != root(b[5]) and similarity(bag[a[4]], bag[b[4]]) >= SIMILARITY:
                known[root(a[5])] = root(b[5])
                out.append((a[5], b[5]))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return held


def _with_classes(docs: DataFrame) -> DataFrame:
    rows, nodes = classes(docs)
    out = join_hot(rows, nodes, "node", "n", rows.count())
    return out.select("doc_id", "mark", "class_id", "class_size", (F.col("row") == F.col("class_k")).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size (rows), kept (in each class one row of the least doc_id)."""
    return _with_classes(docs).drop("mark")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The row of each class that has the least doc_id, with all its columns."""
    one = stored(_with_classes(docs).groupBy(F.col("mark").alias("node"), "doc_id").agg(F.count(F.lit(1)).alias("c"), F.max("kept").alias("kept")), "near-rows")
    return keep_rows(docs, marks()[0], one.where(~F.col("kept")).select("node", "doc_id"), one.where(F.col("kept") & (F.col("c") > 1)).select("node"))
