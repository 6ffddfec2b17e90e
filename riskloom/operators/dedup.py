"""The best finding for each file, line and rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dedup_findings(findings: DataFrame, *more: str) -> DataFrame:
    """Syntax-tree findings beat others, then higher confidence, then what came first. seq becomes that of the first of its key."""
    key = W.partitionBy(*more, "file", "line", "rule_id")
    best = key.orderBy((F.col("analyzer") == "python-ast").desc(), F.col("confidence").desc(), "seq")
    ranked = findings.withColumns({"rl_rank": F.row_number().over(best), "rl_first": F.min("seq").over(key)})
    return ranked.where("rl_rank = 1").withColumn("seq", F.col("rl_first")).drop("rl_rank", "rl_first")
