"""Document fingerprints: consistent weighted sampling over word pairs, weighted by how often they occur.

A fingerprint is SAMPLES 16-bit hashes of samples, in hex; the share of equal ones estimates the generalised Jaccard similarity of two
texts' pairs, which 64 bits of hash tell apart, however long the texts. One word alone is a pair of its own. Texts without a word (null
counts as empty) have a fingerprint of their own, alike to each other and unlike all others. Texts of any length are read whole; a long
one is sampled in blocks of its pairs.

The next document comes in descending order of doc_id (rows that share it: by a hash of the text; null doc_id last); after the last comes
the first. Rows are sorted into ranges of (doc_id, hash, number of the row), so that rows which share a doc_id, or are alike, spread over
tasks; rows that are alike are interchangeable. A range's last document meets the first of the next range in a join on the range's number.
An empty table gives an empty result, a single document is its own next one. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions, stored, text_of
from .sampling import Sampler, bags, slices

SAMPLES, SEED, WIDTH = 64, 11, 2
OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Fingerprinter:
    def __init__(self, samples: int = SAMPLES):
        # Pairs that occur once or twice are most of them: a weight of 2 counts as 1.
        self.sampler = Sampler(samples, SEED, 2.0)

    def of(self, texts: list[str]) -> np.ndarray:
        """The fingerprints as rows of 16-bit numbers."""
        every, out = pa.array(texts, pa.large_string()), [np.zeros((0, self.sampler.samples), ">u2")]
        for i, j in slices(every):
            out.append((self.sampler.sample(*bags(every.slice(i, j - i), WIDTH)) >> np.uint64(48)).astype(">u2"))
        return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples of fingerprints, row by row."""
    return (a == b).mean(-1)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first ones, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = [x.split()[0] for x in OUT.split(", ")]
_RESULT = pa.schema(list(zip(_NAMES, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))
#: A range's first document (where = 0: its text) and its last one (where = 1).
_EDGE = pa.schema([*_RESULT, ("part", pa.int32()), ("place", pa.int32()), ("edge_id", pa.int64()), ("edge_text", pa.string())])


def compared(fp: Fingerprinter, ids: list[int | None], texts: list[str], following: list[str], own: np.ndarray, following_own: np.ndarray) -> pa.RecordBatch:
    """The result's rows of documents, each with the one after it and both fingerprints."""
    new = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    changed = fp.of(new)
    said = lambda x: [r.tobytes().hex() for r in x]
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], said(own), said(changed), likeness(own, changed), likeness(own, following_own)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)


def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's documents (doc_id, text) in order: the result's rows of all but the last, and its edges."""
    from pyspark import TaskContext

    fp, part = Fingerprinter(), TaskContext.get().partitionId()
    # The last document so far, with its fingerprint.
    ids, texts, own = [], [], None

    def edge(place: int, i: int) -> pa.RecordBatch:
        more = [[part], [place], [ids[i]], [texts[i]]]
        return pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in _RESULT] + [pa.array(v, f.type) for v, f in zip(more, list(_EDGE)[len(_NAMES) :], strict=True)], schema=_EDGE)

    for whole in batches:
        for i, j in slices(whole.column(1)):
            b = whole.slice(i, j - i)
            first, new = own is None, b.column(1).to_pylist()
            ids, texts, made = ids + b.column(0).to_pylist(), texts + new, fp.of(new)
            own = made if first else np.concatenate([own, made])
            if first:
                yield edge(0, 0)
            if len(ids) > 1:
                got = compared(fp, ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
                yield pa.RecordBatch.from_arrays([*got.columns, *(pa.nulls(got.num_rows, f.type) for f in list(_EDGE)[len(_NAMES) :])], schema=_EDGE)
            ids, texts, own = ids[-1:], texts[-1:], own[-1:]
    if ids:
        yield edge(1, 0)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (edge_id, text, following): the result's rows."""
    fp = Fingerprinter()
    for whole in batches:
        for i, j in slices(whole.column(1), 64):
            ids, texts, following = (c.to_pylist() for c in whole.slice(i, j - i).columns)
            yield compared(fp, ids, texts, following, fp.of(texts), fp.of(following))


def query(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("row")]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = stored(rows.mapInArrow(along, f"{OUT}, part int, place int, edge_id bigint, edge_text string"), "fingerprints")
    edges = found.where("part IS NOT NULL").select("part", "place", "edge_id", "edge_text")
    # One row a range and no text: which range comes after which.
    numbers = edges.where("place = 0").select("part")
    by = W.orderBy("part")
    after = numbers.select("part", F.coalesce(F.lead("part").over(by), F.first("part").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("next_part"))
    heads = edges.where("place = 0").select(F.col("part").alias("next_part"), F.col("edge_text").alias("following"))
    tails = edges.where("place = 1").select("part", "edge_id", "edge_text").join(after, "part").join(heads, "next_part")
    last = tails.select("edge_id", "edge_text", "following").mapInArrow(meet, OUT)
    return found.where("part IS NULL").select(*_NAMES).unionByName(last)
