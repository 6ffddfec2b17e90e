"""From documents to packed training sequences, in five stages. Each works on all that the one before it kept.

In every stage null text counts as empty, and rows that repeat, null columns, very long texts, and extra columns of any name and type pass. An
empty table makes an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from riskloom.llm.common import remove, scratch_folder, scratch_path, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that it rejects go. Empty and null texts stay; texts of any length are scanned whole; rows that repeat stay or go
    together, and so do texts that tie. Without labels of both kinds all stay."""
    ship(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the smallest doc_id stays, null last; of rows that share it, one. Empty and null texts are equal to each other."""
    return exact_dedup.dedup_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each class stays, that of the smallest doc_id, null last; of rows that share it, one. Texts without a word
    are one class."""
    ship(spark)
    return near_dedup.dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as the mix takes it, 0 to 3 times. A null source is one of its own; texts without a word have size 0
    and are taken as often as their source's other short ones; rows that are alike are taken in any order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a row for each piece, with its sequence and its place there. Empty and null texts are a piece of the end id; long texts are
    cut into pieces; rows that repeat are packed as often as they stand there."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL expresses the stages of operators 4, 9 and 7.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents; each is written as Parquet to the shared folder and read by the next. What a stage stored on its way,
    and the result of the stage before it, go when its own result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch_path(spark, f"stage-{name}")
        with scratch_folder(spark, name):
            stage(spark, docs, sf_dir).write.parquet(at)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(at), at
    return docs
