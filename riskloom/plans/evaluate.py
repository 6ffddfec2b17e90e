"""Findings against labels: which rules were expected of which file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_file(detected: DataFrame, expected: DataFrame) -> DataFrame:
    """file, expected, detected, tp, fp, fn from (file, rule_id) rows on both sides. Rules count once a file."""
    d = detected.select("file", "rule_id").distinct().withColumn("d", F.lit(1))
    e = expected.select("file", "rule_id").distinct().withColumn("e", F.lit(1))
    both = e.join(d, ["file", "rule_id"], "full_outer")
    n = lambda cond: F.count_if(cond)
    has_d, has_e = F.col("d").isNotNull(), F.col("e").isNotNull()
    return both.groupBy("file").agg(n(has_e).alias("expected"), n(has_d).alias("detected"), n(has_d & has_e).alias("tp"), n(has_d & ~has_e).alias("fp"), n(~has_d & has_e).alias("fn"))


def summary(by_file: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, passed. A ratio without a denominator is 1."""
    t = by_file.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    t = t.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    t = t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return t.withColumn("passed", (F.col("fp") == 0) & (F.col("fn") == 0))
