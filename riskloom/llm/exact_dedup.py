"""Exact dedup: a persistent digest index, bucketed and sorted by digest; new rows meet it in a sort-merge anti-join and are appended.

Texts are equal when they are identical once each run of white space is one space. Null counts as empty, so all null and empty
texts are one group (unless a text is only white space: that becomes one space, which is another text). Texts of any length are digested
whole. Of equal texts the row with the smallest doc_id stays (a null doc_id comes last); of rows that share that doc_id and text, the first in
the order of the input's partitions. An empty table gives an empty result. Extra columns are never read, whatever their names and types.

An index is a folder: `meta` says its format and number of buckets, which hold for ever, whatever the session's settings are; `data` has a
partition for each batch. A batch that is added again under its name replaces what it wrote before, and doesn't know its own digests: so a
run that was lost after the index was written can be repeated, with the same result (as long as no other batch came in between).

Only DataFrame operations run here. Hot digests: counting is pre-aggregated in each task. A digest with more than a thousandth of
all rows is joined by broadcast (there are fewer than a thousand such digests, at any size); the others by sort-merge join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, join_hot, keep_rows, make_folder, partitions, scratch_path, stored, text_of

FORMAT = 2


def digest_of(text: Column) -> Column:
    """sha256 (32 bytes) of the text in UTF-8, white space made single spaces."""
    # Never null, and said so: else joins on it would look for nulls first, and digest every text for that.
    return F.coalesce(F.unhex(F.sha2(F.regexp_replace(text, SPACE, " "), 256)), F.lit(b""))


class DigestIndex:
    """digest -> the doc_id that stays, at a location that outlives the session."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        self.spark, self.location = spark, location or scratch_path(spark, "digest-index")
        try:
            meta = spark.read.schema("format int, buckets int").parquet(f"{self.location}/meta").first()
        except AnalysisException:
            meta = None
        if meta is None:
            self.buckets = buckets or partitions(spark)
            spark.range(1).select(F.lit(FORMAT).alias("format"), F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.location}/meta")
        elif meta["format"] != FORMAT or (buckets or meta["buckets"]) != meta["buckets"]:
            raise ValueError(f"the index at {self.location} has format {meta['format']} and {meta['buckets']} buckets")
        else:
            self.buckets = meta["buckets"]

    @contextmanager
    def _table(self) -> Iterator[str]:
        """The index under a name in the catalogue, which goes again; the files stay."""
        name = f"rl_digest_index_{uuid.uuid4().hex}"
        make_folder(self.spark, f"{self.location}/data")
        columns = "digest BINARY, keep_id BIGINT, batch STRING"
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/data'")
        try:
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def entries(self) -> DataFrame:
        """digest, keep_id, batch."""
        try:
            return self.spark.read.schema("digest BINARY, keep_id BIGINT, batch STRING").parquet(f"{self.location}/data")
        except AnalysisException:
            return self.spark.createDataFrame([], "digest BINARY, keep_id BIGINT, batch STRING")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Dedup docs (doc_id, text) against the index and among themselves; append what is new, as a batch.

        Returns digest, doc_id, keep_id, group_size (rows of docs with this text), kept (one row for each text that the index
        didn't have), in a row for each row of docs.
        """
        batch = batch or uuid.uuid4().hex
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest_of(text_of()).alias("digest"), F.monotonically_increasing_id().alias("row"))
        rows = stored(rows, "digests")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        groups = rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))
        with self._table() as name:
            known = self.spark.table(name).where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
            # The index stays where it is: the new digests are dealt as it is.
            met = groups.repartition(self.buckets, "digest").hint("merge").join(known.hint("merge"), "digest", "left")
            keep = F.when(F.col("known"), F.col("known_id")).otherwise(F.col("first.doc_id")).alias("keep_id")
            met = stored(met.select("digest", keep, "group_size", F.when(F.col("known").isNull(), F.col("first.row")).alias("kept_row")), "digest-groups")
            fresh = stored(met.select("digest", "keep_id").repartition(self.buckets, "digest").hint("merge").join(known.select("digest").hint("merge"), "digest", "left_anti"), "fresh")
            # Each task has one bucket's rows, so each bucket gets one file.
            fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").createOrReplaceTempView(f"{name}_fresh")
            try:
                self.spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch = '{batch}') SELECT digest, keep_id FROM {name}_fresh")
            finally:
                self.spark.catalog.dropTempView(f"{name}_fresh")
        out = join_hot(rows, met, "digest", "group_size", rows.count())
        return out.select("digest", "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False)).alias("kept"))


def dedup_documents(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = stored((index or DigestIndex(docs.sparkSession)).add(docs, batch), "dedup-rows")
    # Rows that share doc_id and text can't be told apart by a join: those nodes keep one row in keep_rows.
    one = found.groupBy(F.col("digest").alias("node"), "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    drop = one.where(~F.col("kept")).select("node", "doc_id")
    again = one.where(F.col("kept") & (F.col("n") > 1)).select("node")
    return keep_rows(docs, digest_of(text_of()), drop, again)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Two batches through one index: the rows up to the middle doc_id, then the others, which meet what the first ones left there."""
    middle = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), 0.5)).first()[0]
    early = F.coalesce(F.col("doc_id").cast("bigint") <= F.lit(middle), F.lit(False))
    index = DigestIndex(spark)
    found = stored(index.add(docs.where(early), "first").unionByName(index.add(docs.where(~early), "second")), "both-batches")
    sizes = stored(found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")), "both-sizes")
    found = join_hot(found.drop("group_size"), sizes, "digest", "group_size", found.count())
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       coalesce(doc_id = min(doc_id) OVER (PARTITION BY text_sha256)
         AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1, false) AS kept,
       text_sha256
FROM d
"""
