"""Lines against rules.

The rules are a literal array of predicates and not a table to join: patterns are compiled once a task, a line's rules stay in one
stage, and that a malware hit silences the language rules needs no second look at the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .rules import RULES, Rule, by_family, java_pattern, rules_frame

#: Producers in the order in which they report: executables, then line by line the rules.
ARTIFACT, TREE, LINE = 0, 1, 2


def _hits(c: Column, rules: list[Rule], numbers: dict[str, int]) -> Column:
    return F.array(*[F.when(c.rlike(java_pattern(r)), F.lit(numbers[r.rule_id])) for r in rules]) if rules else F.array().cast("array<int>")


def coded(lines: DataFrame, rules: tuple[Rule, ...] = RULES, covered: Column | None = None) -> tuple[DataFrame, Column]:
    """lines (line, stripped, and more) with columns that the numbers of the rules which it meets, an array, are made of. A null line meets none.

    Secrets and malware are searched in the stripped line, language rules in it without its comment. A malware hit, a comment line,
    or being covered by a syntax tree's finding leaves no language rule. The array is to be exploded right away: a projection of its own
    would be folded with the one that makes the code, and make it anew for each rule.
    """
    numbers = {r.rule_id: i for i, r in enumerate(rules)}
    # One projection makes the code; the predicates read its result.
    made = lines.withColumn("rl_code", F.when(~X.is_comment_line(F.col("line")), X.strip(X.strip_inline_comment(F.col("line")))))
    made = made.withColumn("rl_malware", F.array_compact(_hits(F.col("line"), by_family("malware", rules), numbers)))
    searched = (F.size("rl_malware") == 0) & (F.col("rl_code") != "")
    if covered is not None:
        searched = searched & ~covered
    language = F.when(searched, F.array_compact(_hits(F.col("rl_code"), by_family("language", rules), numbers))).otherwise(F.array().cast("array<int>"))
    return made, F.concat(F.array_compact(_hits(F.col("line"), by_family("secret", rules), numbers)), F.col("rl_malware"), language)


def match_lines(lines: DataFrame, rules: tuple[Rule, ...] = RULES, covered: Column | None = None) -> DataFrame:
    """A row for each rule that a line meets: the columns of lines, and rule_no."""
    made, every = coded(lines.withColumn("line", X.strip(F.col("line"))).where("line <> ''"), rules, covered)
    return made.withColumn("rule_no", F.explode(every)).drop("rl_code", "rl_malware")


def match_by_join(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """The same search as a join on a pattern, for one family: a second formulation, for tests."""
    return lines.join(F.broadcast(rules), F.expr("line RLIKE java_pattern"))


def with_rule(hits: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """hits (rule_no) with the rule's attributes. The catalogue is broadcast: it has as many rows as there are rules."""
    return hits.join(F.broadcast(rules_frame(hits.sparkSession, rules).drop("pattern", "cased")), "rule_no")


def findings(hits: DataFrame, rules: tuple[Rule, ...] = RULES, found: str | None = None) -> DataFrame:
    """hits (file, line_num, line, rule_no) as findings. seq orders them as they are reported.

    Hits of the artifact rule are of the whole file. Where the column `found` holds a syntax tree's finding, that goes for what the rule and the
    line say.
    """
    h, own = with_rule(hits, rules), lambda n: F.col(f"{found}.{n}") if found else F.lit(None)
    either = lambda n, c=None: F.coalesce(own(n), F.col(n) if c is None else c).alias(n)
    none = lambda n, kind: own(n).cast(kind).alias(n)
    whole = F.col("family") == "artifact"
    at = F.when(whole, F.lit(0)).otherwise(F.col("line_num").cast("int"))
    said = F.when(whole, F.col("line")).otherwise(X.snippet(either("snippet", F.col("line"))))
    order = F.array(F.when(whole, F.lit(ARTIFACT)).otherwise(F.lit(LINE)), at, F.col("rule_no"))
    return h.select(
        "file", either("line", at), none("column", "int"), none("end_line", "int"), none("end_column", "int"),
        "rule_id", "title", either("description"), either("severity"), either("confidence"), "category", said.alias("snippet"), F.lit("").alias("evidence"),
        (F.when(own("rule_id").isNotNull(), F.lit("python")).otherwise(F.col("language")) if found else F.col("language")).alias("language"), "remediation",
        F.when(own("rule_id").isNotNull(), F.lit("python-ast")).when(whole, F.lit("filesystem")).otherwise(F.lit("regex")).alias("analyzer"),
        "cwe", either("score"), F.lit(None).cast("string").alias("cvss_vector"), F.lit(None).cast("double").alias("cvss_score"), F.create_map().cast("map<string,string>").alias("metadata"),
        either("seq", order),
    )


def artifact_line(name: Column) -> Column:
    """What a finding says of an executable."""
    return F.concat(F.lit("Executable artifact detected: "), name)


def artifact_findings(files: DataFrame, name: str = "file", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Paths of executables (file, each once) as findings about the whole file, which say the column `name`."""
    number = next(i for i, r in enumerate(rules) if r.family == "artifact")
    return findings(files.select("file", F.lit(0).alias("line_num"), artifact_line(F.col(name)).alias("line"), F.lit(number).alias("rule_no")), rules)
