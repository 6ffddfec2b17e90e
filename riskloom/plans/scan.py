"""Scans: a tree of files, or unified diffs, to deduplicated findings.

A scan reads its input once. All that is to be looked at in a file, or in a diff's part on one file, is an array of pieces: its lines, what its
syntax tree says, and its name if it is an executable. Pieces are exploded and matched in one stage; the only shuffle is that of dedup, over
findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import SYNTAX
from ..functions.text import line_array, line_count, strip
from ..operators.dedup import dedup_findings
from ..operators.diff import added_array, file_parts
from ..operators.match import artifact_line, coded, findings
from ..operators.paths import is_artifact, is_ignored, is_pruned
from ..operators.pyast import is_python, syntax_calls
from ..operators.rules import RULES, Rule
from ..sources.tree import read_tree


_PIECE = f"struct<line_num: int, line: string, rule_no: int, found: struct<{SYNTAX}>>"


def _none() -> Column:
    """No pieces."""
    return F.array().cast(f"array<{_PIECE}>")


def _piece(line_num: Column, line: Column, rule_no: Column | None = None, found: Column | None = None) -> Column:
    """A line's rules are those that it meets; a piece of another kind comes with its rule."""
    none = F.lit(None).cast(f"struct<{SYNTAX}>")
    number = F.lit(None) if rule_no is None else rule_no
    return F.struct(line_num.cast("int").alias("line_num"), line.alias("line"), number.cast("int").alias("rule_no"), (none if found is None else found).alias("found"))


def _findings(pieces: DataFrame, rules: tuple[Rule, ...], covered: Column | None = None) -> DataFrame:
    """Pieces (file, p, more) as findings."""
    # Only lines are searched, and stripped; a syntax tree's finding and a name come with their rule.
    flat = pieces.select("*", "p.*").drop("p").withColumns({"name": F.when(F.col("rule_no").isNotNull(), F.col("line")), "line": strip(F.col("line"))})
    made, every = coded(flat, rules, covered)
    hits = made.withColumn("rl_no", F.explode(F.when(F.col("rule_no").isNotNull(), F.array("rule_no")).otherwise(every)))
    return findings(hits.withColumns({"rule_no": F.col("rl_no"), "line": F.coalesce("name", "line")}).drop("rl_no", "rl_code", "rl_malware", "name"), rules, "found")


def _artifact(rules: tuple[Rule, ...]) -> Column:
    return F.lit(next(i for i, r in enumerate(rules) if r.family == "artifact"))


def scan_files(files: DataFrame, ignore: tuple[str, ...] | list[str] = (), rules: tuple[Rule, ...] = RULES, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """Findings of files (file, content), and one row with lines_scanned. Executables' contents aren't read."""
    kept = files.where(~is_ignored(F.col("file"), ignore) & (~is_pruned(F.col("file")) if prune else F.lit(True)))
    text = F.when(~is_artifact(F.col("file")), F.col("content"))
    # Only Python files' texts go to Python.
    parsed = kept.select("file", text.alias("content")).withColumn("tree", syntax_calls(F.when(is_python(F.col("file")), F.col("content"))))
    numbers = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.rule_id), F.lit(i))])
    lines = F.transform(line_array(F.col("content")), lambda x, i: _piece(i + 1, x))
    calls = F.transform("tree", lambda f: _piece(f["line"], F.lit(None).cast("string"), numbers[f["rule_id"]], f))
    name = F.array(_piece(F.lit(0), artifact_line(F.element_at(F.split("file", "/"), -1)), _artifact(rules)))
    every = F.when(is_artifact(F.col("file")), name).otherwise(F.concat(calls, F.coalesce(lines, _none())))
    pieces = parsed.select("file", F.transform("tree", lambda f: f["line"]).alias("covered"), F.explode(every).alias("p"))
    out = _findings(pieces, rules, F.array_contains("covered", F.col("line_num")))
    return dedup_findings(out), kept.select(text.alias("content")).agg(F.coalesce(F.sum(line_count(F.col("content"))), F.lit(0)).cast("bigint").alias("lines_scanned"))


def scan_tree(spark: SparkSession, path: str, ignore: tuple[str, ...] | list[str] = (), rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The same for a path; the source has pruned and ignored already."""
    files = read_tree(spark, path, ignore).select("file", F.coalesce("content", F.lit("")).alias("content"))
    return scan_files(files, ignore, rules, prune=False)


def scan_diffs(diffs: DataFrame, ignore: tuple[str, ...] | list[str] = (), key: str = "diff_id", text: str = "content", rules: tuple[Rule, ...] = RULES, strict_paths: bool = False, count_context: bool = False) -> DataFrame:
    """Findings of diffs (key, text), each with its key. Only added lines are searched; a diff has no syntax tree."""
    parts = file_parts(diffs, key, text, strict_paths).where(~is_ignored(F.col("path"), ignore))
    lines = F.transform(added_array(F.col("part"), count_context), lambda x: _piece(F.greatest(x["line_num"], F.lit(0)), x["line"]))
    name = F.when(F.col("named") & is_artifact(F.col("file")), F.array(_piece(F.lit(0), artifact_line(F.col("file")), _artifact(rules)))).otherwise(_none())
    # A struct carries the diff through: findings look only at the file.
    pieces = parts.select(F.struct(F.col(key), F.col("file")).alias("file"), F.explode(F.concat(name, lines)).alias("p"))
    out = _findings(pieces, rules).withColumn(key, F.col(f"file.{key}")).withColumn("file", F.col("file.file"))
    return dedup_findings(out, key)
