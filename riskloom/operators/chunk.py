"""The part of a diff that fits in a prompt: sections with code or risky lines first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import strip
from .rules import RULES, java_pattern

# What marks a section's first line as code (found anywhere in it), and how a cut section ends.
CODE = (".py", ".go", ".rs", ".js", ".ts", ".java", ".php", ".c", ".cpp", ".h", ".hpp", ".rb", ".sh", ".yml", ".yaml")
CUT = "\n... [diff truncated for length]"
LEAST = 200
#: What stands in for a review where no model can be asked.
SKIPPED = "AI review is not available; the deterministic scan is complete."


def sections(diffs: DataFrame, key: str = "diff_id", text: str = "content") -> DataFrame:
    """key, idx, section, priority: the non-empty sections, split before each `diff --git `."""
    parts = F.filter(F.transform(F.split(F.col(text), "(?=diff --git )"), strip), lambda s: s != "")
    out = diffs.select(key, F.posexplode(parts).alias("idx", "section"))
    head = F.substring_index("section", "\n", 1)
    code = F.exists(F.array(*[F.lit(x) for x in CODE]), lambda x: F.contains(head, x))
    risky = F.lit(False)
    for r in RULES:
        if r.pattern:
            risky = risky | F.col("section").rlike(java_pattern(r))
    return out.withColumn("priority", (code | risky).cast("int"))


def select_chunks(diffs: DataFrame, most: int = 12000, key: str = "diff_id", text: str = "content") -> DataFrame:
    """key, chunk: texts of up to `most` characters as they are; of others, sections in order of priority while they fit, then the next
    one cut to what is left if that is over LEAST. If nothing fits, the first `most` characters."""
    short = F.length(text) <= most
    along = W.partitionBy(key).orderBy(F.col("priority").desc(), "idx")
    parts = sections(diffs.where(~short), key, text)
    parts = parts.withColumns({"upto": F.sum(F.length("section")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)), "no": F.row_number().over(along)})
    room = F.lit(most) - (F.col("upto") - F.length("section"))
    # The first section that doesn't fit is the only one with upto above and its own beginning not above the limit.
    take = F.when(F.col("upto") <= most, F.col("section")).when((room >= 0) & (room > LEAST), F.concat(F.substring("section", F.lit(1), room.cast("int")), F.lit(CUT)))
    got = parts.withColumn("taken", take).where("taken IS NOT NULL").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "taken"))), lambda x: x.taken), "\n\n").alias("chosen"))
    out = diffs.join(got, key, "left")
    return out.select(key, F.when(short, F.col(text)).otherwise(F.coalesce("chosen", F.substring(text, 1, most))).alias("chunk"))
