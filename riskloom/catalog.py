"""The registered queries of the engine's own operators, and the DuckDB SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus as C
from .functions import text as X
from .operators import chunk, dedup, diff, match, paths, pyast
from .operators.rules import RULES, re2_pattern, rules_frame
from .plans import evaluate, report, scan
from .sources import tree

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(f: Callable[[SparkSession, str], DataFrame]):
    _Q[f.__name__] = f
    return f


def _lit(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_RULES = "rules(rule_no, rule_id, title, description, family, pattern, category, severity, score, confidence, cwe, language, remediation) AS (VALUES " + ", ".join(
    f"({i}, {_lit(r.rule_id)}, {_lit(r.title)}, {_lit(r.description)}, {_lit(r.family)}, {_lit(re2_pattern(r) if r.pattern else None)}, {_lit(r.category)}, {_lit(r.severity)}, CAST({r.score} AS DOUBLE), CAST({r.confidence} AS DOUBLE), {_lit(r.cwe)}, {_lit(r.language)}, {_lit(r.remediation)})" for i, r in enumerate(RULES)
) + ")"
_MASK = r"regexp_replace({0}, '([A-Za-z0-9_\-]{{4}})[A-Za-z0-9_\-]{{4,}}([A-Za-z0-9_\-]{{4}})', '\1...\2', 'g')"
_SNIP = "substr(" + _MASK + ", 1, 80)"
_WS = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_COMMENT = r"({0} = '' OR regexp_matches({0}, '^(?:#|//|/\*|\*|<!--|-->|--|;|REM |rem )'))"
_IGNORED = "regexp_matches({0}, " + _lit("(?i)" + "|".join(f"(?:{p})" for p in paths.IGNORED)) + ")"
_ARTIFACT = "regexp_matches(lower({0}), " + _lit("(?:" + "|".join(x.replace(".", r"\.") for x in paths.ARTIFACTS) + ")$") + ")"


def _walk(source: str) -> str:
    """Of source (id, t): code(id, t, code), t cut at its comment, one character after the other."""
    return f"""walk(id, i, q, cut) AS (
  SELECT id, 1, '', 0 FROM {source}
  UNION ALL
  SELECT w.id, CASE WHEN substr(s.t, w.i, 1) = '\\' THEN w.i + 2 ELSE w.i + 1 END,
    CASE WHEN w.q = '' AND substr(s.t, w.i, 1) IN ('''', '"', '`') THEN substr(s.t, w.i, 1) WHEN w.q <> '' AND substr(s.t, w.i, 1) = w.q THEN '' ELSE w.q END,
    CASE WHEN w.q = '' AND (substr(s.t, w.i, 1) = '#' OR substr(s.t, w.i, 2) IN ('//', '--')) THEN w.i ELSE 0 END
  FROM walk w JOIN {source} s ON s.id = w.id WHERE w.i <= length(s.t) AND w.cut = 0
), cuts AS (
  SELECT id, max(cut) AS cut FROM walk GROUP BY id
), code AS (
  SELECT s.id, s.t, CASE WHEN c.cut > 0 THEN regexp_replace(substr(s.t, 1, c.cut - 1), '\\s+$', '') ELSE s.t END AS code FROM {source} s JOIN cuts c USING (id)
)"""


def _hits(lines: str) -> str:
    """Of lines (id, file, line_num, t): hits (id, file, line_num, t, rule_no, ...), as joins on the patterns."""
    return f"""kept AS (SELECT id, file, line_num, {_WS.format("t")} AS t FROM {lines} WHERE {_WS.format("t")} <> ''),
{_walk("kept")},
bad AS (SELECT DISTINCT k.id FROM kept k JOIN rules r ON r.family = 'malware' AND regexp_matches(k.t, r.pattern)),
hits AS (
  SELECT k.*, r.* FROM kept k JOIN rules r ON r.family IN ('secret', 'malware') AND regexp_matches(k.t, r.pattern)
  UNION ALL
  SELECT k.*, r.* FROM kept k JOIN code c USING (id) JOIN rules r ON r.family = 'language' AND regexp_matches({_WS.format("c.code")}, r.pattern)
  WHERE NOT {_COMMENT.format("k.t")} AND k.id NOT IN (SELECT id FROM bad)
)"""


def _found(extra: str = "") -> str:
    return f"WITH RECURSIVE {C.corpus_sql()}, {_RULES}, given AS (SELECT event_id AS id, file, line_num, text AS t FROM corpus{extra}), {_hits('given')}"


def _corpus_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.corpus(spark, sf_dir)
    return match.match_lines(c.select("event_id", "file", "line_num", F.col("text").alias("line")))


def _corpus_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.findings(_corpus_hits(spark, sf_dir))


@_add
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lines to deduplicated findings, counted by rule and severity."""
    return dedup.dedup_findings(_corpus_findings(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


_SQL["rule_counts"] = _found() + " SELECT rule_id, severity, count(DISTINCT (file, line_num)) AS n FROM hits GROUP BY ALL"


@_add
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_findings(_corpus_findings(spark, sf_dir)).groupBy("category", "cwe", "language").agg(F.count(F.lit(1)).alias("n"))


_SQL["category_counts"] = _found() + " SELECT category, cwe, language, count(DISTINCT (file, line_num, rule_id)) AS n FROM hits GROUP BY ALL"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_DOC_LINES = r"""doc_lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_num FROM (
    SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""


@_add
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lines(_documents(spark, sf_dir), "text", "doc_id").select("doc_id", "line_num", F.md5("line").alias("line_md5"))


_SQL["line_split"] = f"WITH {_DOC_LINES} SELECT doc_id, CAST(line_num AS INT) AS line_num, md5(line) AS line_md5 FROM doc_lines"


@_add
def lines_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy("lang").agg(F.sum(X.line_count(F.col("text"))).alias("lines"))


_SQL["lines_scanned"] = f"WITH {_DOC_LINES} SELECT lang, count(*) AS lines FROM doc_lines JOIN documents USING (doc_id) GROUP BY lang"


@_add
def nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = X.lines(_documents(spark, sf_dir), "text", "doc_id").where(X.strip(F.col("line")) != "")
    return at.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_SQL["nonblank_lines"] = f"WITH {_DOC_LINES} SELECT doc_id, count(*) AS n FROM doc_lines WHERE {_WS.format('line')} <> '' GROUP BY doc_id"


@_add
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lines(_documents(spark, sf_dir), "text", "doc_id").select("doc_id", "line_num", F.md5(X.mask(F.col("line"))).alias("masked_md5"))


_SQL["mask_values"] = f"WITH {_DOC_LINES} SELECT doc_id, CAST(line_num AS INT) AS line_num, md5({_MASK.format('line')}) AS masked_md5 FROM doc_lines"


@_add
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lines(_documents(spark, sf_dir), "text", "doc_id").select("doc_id", "line_num", X.snippet(F.col("line")).alias("snippet"))


_SQL["snippets"] = f"WITH {_DOC_LINES} SELECT doc_id, CAST(line_num AS INT) AS line_num, {_SNIP.format('line')} AS snippet FROM doc_lines"


@_add
def comment_line_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus(spark, sf_dir).select("event_id", X.is_comment_line(F.col("text")).alias("is_comment"))


_SQL["comment_line_flag"] = f"WITH {C.corpus_sql()} SELECT event_id, {_COMMENT.format(_WS.format('text'))} AS is_comment FROM corpus"


@_add
def strip_inline_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus(spark, sf_dir).select("event_id", X.strip_inline_comment(F.col("text")).alias("code"))


_SQL["strip_inline_comment"] = f"WITH RECURSIVE {C.corpus_sql()}, given AS (SELECT event_id AS id, text AS t FROM corpus), {_walk('given')} SELECT id AS event_id, code FROM code"


@_add
def strip_inline_comment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on lines of prose."""
    at = X.lines(_documents(spark, sf_dir), "text", "doc_id").withColumn("code", X.strip_inline_comment(F.col("line")))
    return at.select("doc_id", "line_num", F.length("code").alias("kept"), F.md5("code").alias("code_md5"))


# Tokens in turn: an escape, a quoted run (to the line's end if it isn't closed), a comment sign, or a character.
_TOKEN = r"""(?s)\\.|'(?:[^'\\]|\\.)*'?|"(?:[^"\\]|\\.)*"?|`(?:[^`\\]|\\.)*`?|#|//|--|."""
_SQL["strip_inline_comment_documents"] = f"""WITH {_DOC_LINES}, tokens AS (SELECT doc_id, line_num, line, regexp_extract_all(line, {_lit(_TOKEN)}) AS t FROM doc_lines),
cut AS (SELECT *, coalesce(list_position(list_transform(t, lambda x: x IN ('#', '//', '--')), true), 0) AS p FROM tokens),
code AS (SELECT doc_id, CAST(line_num AS INT) AS line_num, CASE WHEN p > 0 THEN regexp_replace(array_to_string(t[:p - 1], ''), '\\s+$', '') ELSE line END AS code FROM cut)
SELECT doc_id, line_num, CAST(length(code) AS INT) AS kept, md5(code) AS code_md5 FROM code"""


@_add
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.corpus(spark, sf_dir).select("file").distinct()
    return f.select("file", paths.is_ignored(F.col("file")).alias("ignored"), paths.is_pruned(F.col("file")).alias("pruned"), paths.is_artifact(F.col("file")).alias("artifact"))


_PRUNED = "list_bool_or(list_transform(list_concat([''], string_split(file, '/')[:-2]), lambda f: f IN (" + ", ".join(map(_lit, paths.PRUNED)) + ") OR " + _IGNORED.format("f") + "))"
_SQL["ignored_paths"] = f"WITH {C.corpus_sql()} SELECT DISTINCT file, {_IGNORED.format('file')} AS ignored, {_PRUNED} AS pruned, {_ARTIFACT.format('file')} AS artifact FROM corpus"


@_add
def custom_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.corpus(spark, sf_dir).select("file").distinct()
    return f.select("file", paths.is_ignored(F.col("file"), ["u1*/main.py", "*.go"]).alias("ignored"))


_SQL["custom_ignore"] = f"WITH {C.corpus_sql()} SELECT DISTINCT file, ({_IGNORED.format('file')} OR regexp_matches(file, '(?i)u1.*/main\\.py|.*\\.go')) AS ignored FROM corpus"


@_add
def artifact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = paths.artifacts(C.corpus(spark, sf_dir))
    return match.artifact_findings(f).select("file", "line", "rule_id", "severity", "analyzer", "snippet")


_SQL["artifact_findings"] = f"WITH {C.corpus_sql()} SELECT DISTINCT file, CAST(0 AS INT) AS line, 'MAL-BIN-ARTIFACT-001' AS rule_id, 'CRITICAL' AS severity, 'filesystem' AS analyzer, 'Executable artifact detected: ' || file AS snippet FROM corpus WHERE {_ARTIFACT.format('file')}"


def _family(name: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = match.with_rule(_corpus_hits(spark, sf_dir)).where(F.col("family") == name)
        return h.select("event_id", "file", "line_num", "rule_id")

    f.__name__ = f"{name}_matches"
    _add(f)
    _SQL[f.__name__] = _found() + f" SELECT id AS event_id, file, line_num, rule_id FROM hits WHERE family = '{name}'"


for _name in ("secret", "malware", "language"):
    _family(_name)


@_add
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_frame(spark).select("rule_no", "rule_id", "title", "family", "category", "severity", "score", "confidence", "cwe", "language")


_SQL["rule_catalogue"] = f"WITH {_RULES} SELECT CAST(rule_no AS INT) AS rule_no, rule_id, title, family, category, severity, score, confidence, cwe, language FROM rules"


@_add
def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding comes thrice: as it is, from another analyzer at less confidence, and as a syntax-tree finding for some lines."""
    f = _corpus_findings(spark, sf_dir)
    less = f.withColumns({"confidence": F.col("confidence") - 0.5, "analyzer": F.lit("other")})
    tree = f.where(F.col("line") % 3 == 0).withColumns({"confidence": F.lit(0.8), "analyzer": F.lit("python-ast")})
    return dedup.dedup_findings(less.unionByName(f).unionByName(tree)).select("file", "line", "rule_id", "analyzer", X.confidence_text(F.col("confidence")).alias("confidence"))


_SQL["dedup_findings"] = _found() + """ SELECT file, line_num AS line, rule_id, CASE WHEN line_num % 3 = 0 THEN 'python-ast' ELSE 'regex' END AS analyzer,
  CASE WHEN line_num % 3 = 0 THEN '80%' ELSE CAST(CAST(floor(confidence * 100) AS INT) AS VARCHAR) || '%' END AS confidence FROM hits"""


@_add
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.finding_rows(_corpus_findings(spark, sf_dir)).drop("metadata", "cvss_vector", "cvss_score", "column")


_ROW = """ SELECT rule_id, severity, title AS type, description, format('{:.1f}', score) AS score, CAST(CAST(floor(confidence * 100) AS INT) AS VARCHAR) || '%' AS confidence,
  file || ':' || line_num AS file, """ + _SNIP.format("t") + """ AS snippet, category, 'regex' AS analyzer, cwe, remediation, line_num AS line FROM hits"""
_SQL["finding_rows"] = _found() + _ROW


@_add
def finding_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows back to findings. A column in the place makes the line the column: the last colon splits it."""
    f = _corpus_findings(spark, sf_dir).withColumn("column", F.when(F.col("line") % 2 == 0, F.lit(4)))
    out = report.from_rows(report.finding_rows(f))
    return out.select("rule_id", "file", "line", "severity", X.confidence_text(F.round("confidence", 4)).alias("confidence"), "title", "category")


_SQL["finding_roundtrip"] = _found() + """ SELECT rule_id, CASE WHEN line_num % 2 = 0 THEN file || ':' || line_num ELSE file END AS file, CAST(CASE WHEN line_num % 2 = 0 THEN 4 ELSE line_num END AS INT) AS line,
  severity, CAST(CAST(floor(round(confidence, 4) * 100) AS INT) AS VARCHAR) || '%' AS confidence, title, category FROM hits"""


@_add
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts(_corpus_findings(spark, sf_dir))


_SQL["severity_counts"] = _found() + " SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high FROM hits"


#: Severities by line, so that every rank and an unknown one occur; the rest keep their rule's.
_MIXED = ("LOW", "INFO", "MEDIUM", "odd")


def _mixed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, _MIXED)), F.col("line") % 7)
    return _corpus_findings(spark, sf_dir).withColumn("severity", F.coalesce(kind, F.col("severity")))


_MIXED_SQL = "coalesce([" + ", ".join(map(_lit, _MIXED)) + "][(line_num % 7) + 1], severity)"
_GATES = ("INFO", "low", "MEDIUM", "HIGH", "CRITICAL", "other")


@_add
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file and each threshold whether the gate fails."""
    return report.gates(_mixed_findings(spark, sf_dir), _GATES, "file")


_SQL["severity_gate"] = _found() + f""", ranks(name, place) AS (VALUES ('INFO', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)),
  worst AS (SELECT file, max(coalesce(place, 1)) AS place FROM (SELECT file, {_MIXED_SQL} AS s FROM hits) LEFT JOIN ranks ON s = name GROUP BY file),
  least(least) AS (VALUES {', '.join(f"({_lit(x)})" for x in _GATES)})
  SELECT file, least, worst.place >= coalesce(r.place, 3) AS fail FROM worst CROSS JOIN least LEFT JOIN ranks r ON r.name = upper(least)"""


@_add
def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows of all severities as SARIF results: places are split at their last colon."""
    return report.sarif_results(report.from_rows(report.finding_rows(_mixed_findings(spark, sf_dir))))


_SQL["sarif_levels"] = _found() + f""" SELECT rule_id, CASE {_MIXED_SQL} WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
  title || ': ' || {_SNIP.format('t')} AS message, file AS uri, CAST(greatest(1, line_num) AS INT) AS start_line FROM hits"""


@_add
def ci_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ci_outputs(_corpus_findings(spark, sf_dir), "results.sarif", "report.html")


_SQL["ci_outputs"] = _found() + " SELECT unnest(['findings-count', 'has-critical', 'sarif-path', 'html-report-path']) AS name, unnest([CAST(count(*) AS VARCHAR), CASE WHEN bool_or(severity = 'CRITICAL') THEN 'true' ELSE 'false' END, 'results.sarif', 'report.html']) AS value FROM hits"


@_add
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown_rows(report.finding_rows(_corpus_findings(spark, sf_dir)))


_SQL["markdown_rows"] = _found() + ", r AS (" + _ROW + ") SELECT '| ' || CASE WHEN severity = 'CRITICAL' THEN '🔴 `CRITICAL`' ELSE '🟠 `HIGH`' END || ' | ' || type || ' | `' || rule_id || '` | **' || score || '** | ' || confidence || ' | `' || snippet || '` |' AS row FROM r"


@_add
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.html_rows(report.finding_rows(_corpus_findings(spark, sf_dir)))


def _esc(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_SQL["html_rows"] = _found() + ", r AS (" + _ROW + ") SELECT '<tr class=\"' || CASE severity WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' ELSE 'medium' END || '\" data-severity=\"' || severity || '\">' || " + " || ".join(f"'<td>' || {_esc(c)} || '</td>'" for c in ("severity", "rule_id", "type", "file", "score", "confidence", "snippet")) + " || '</tr>' AS row FROM r"


@_add
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_results(_corpus_findings(spark, sf_dir))


_SQL["sarif_results"] = _found() + f" SELECT rule_id, 'error' AS level, title || ': ' || {_SNIP.format('t')} AS message, file AS uri, greatest(1, line_num) AS start_line FROM hits"


@_add
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r["id"], r["name"], r["help"]["text"], r["properties"]["security-severity"]) for r in report.sarif_rules()], "id string, name string, help string, security_severity string")


_SQL["sarif_rules"] = f"WITH {_RULES} SELECT rule_id AS id, title AS name, description || chr(10) || chr(10) || 'Remediation: ' || remediation || chr(10) || 'CWE: ' || cwe || chr(10) AS help, format('{{:.1f}}', score) AS security_severity FROM rules"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the templates' labels say each file has, with the rules of one template withheld and of one added, so that both kinds of error occur."""
    pairs = spark.createDataFrame([(i, r) for i, (ids, _) in enumerate(C.TEMPLATES) for r in ids if i != 4] + [(28, "GO-MEM-001")], "template int, rule_id string")
    return C.corpus(spark, sf_dir).join(F.broadcast(pairs), "template").select("file", "rule_id").distinct()


_EXPECTED = "labels(template, rule_id) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, (ids, _) in enumerate(C.TEMPLATES) for r in ids if i != 4) + ", (28, 'GO-MEM-001')), e AS (SELECT DISTINCT file, rule_id FROM corpus JOIN labels USING (template)), d AS (SELECT DISTINCT file, rule_id FROM hits), f AS (SELECT coalesce(e.file, d.file) AS file, e.rule_id AS er, d.rule_id AS dr FROM e FULL JOIN d ON e.file = d.file AND e.rule_id = d.rule_id)"


@_add
def evaluation_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_file(_corpus_findings(spark, sf_dir), _labels(spark, sf_dir))


_PER_FILE = "SELECT file, count(er) AS expected, count(dr) AS detected, count(*) FILTER (er = dr) AS tp, count(*) FILTER (er IS NULL) AS fp, count(*) FILTER (dr IS NULL) AS fn FROM f GROUP BY file"
_SQL["evaluation_per_file"] = _found() + f", {_EXPECTED} {_PER_FILE}"


@_add
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(evaluation_per_file(spark, sf_dir))


_SQL["evaluation_summary"] = _found() + f""", {_EXPECTED}, g AS ({_PER_FILE}), t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM g),
  p AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM t)
  SELECT *, 2 * precision * recall / (precision + recall) AS f1, fp = 0 AND fn = 0 AS passed FROM p"""

_DIFF = f"""signed AS (
  SELECT *, CASE template WHEN 28 THEN ' ' WHEN 25 THEN '-' ELSE '+' END AS sign FROM corpus
), placed AS (
  SELECT event_id AS id, regexp_replace(file, '^[b/]+', '') AS file, file AS diff_id, sign, text AS t,
         CAST(CASE WHEN line_num < 6 THEN 10 ELSE 500 END + count(*) FILTER (sign = '+') OVER (PARTITION BY file, line_num >= 6 ORDER BY line_num) AS INT) AS line_num
  FROM signed
)"""


@_add
def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.added_line_count(C.diffs(spark, sf_dir), "content", "diff_id")


_SQL["diff_added_lines"] = f"WITH {C.corpus_sql()}, {_DIFF} SELECT diff_id, count(*) FILTER (sign = '+' AND NOT starts_with(t, '++')) AS lines_scanned FROM placed GROUP BY diff_id"


@_add
def diff_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = diff.positions(C.diffs(spark, sf_dir)).where("is_added")
    return at.select("diff_id", "file", "line_num", F.expr("substring(raw, 2)").alias("text"))


_SQL["diff_positions"] = f"WITH {C.corpus_sql()}, {_DIFF} SELECT diff_id, file, line_num, t AS text FROM placed WHERE sign = '+'"


@_add
def diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_diffs(C.diffs(spark, sf_dir)).select("diff_id", "file", "line", "rule_id", "snippet", "analyzer")


_SQL["diff_findings"] = f"WITH RECURSIVE {C.corpus_sql()}, {_RULES}, {_DIFF}, given AS (SELECT * FROM placed WHERE sign = '+' AND NOT {_IGNORED.format('diff_id')}), {_hits('given')}" + f""" SELECT diff_id, h.file, h.line_num AS line, rule_id, {_SNIP.format('h.t')} AS snippet, 'regex' AS analyzer FROM hits h JOIN placed p USING (id)
  UNION ALL SELECT DISTINCT diff_id, file, 0, 'MAL-BIN-ARTIFACT-001', 'Executable artifact detected: ' || file, 'filesystem' FROM placed WHERE {_ARTIFACT.format('file')} AND NOT {_IGNORED.format('diff_id')}"""


@_add
def tree_findings_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree scan over files that aren't Python, where only lines and names are searched."""
    f = C.files(spark, sf_dir).where(~F.col("file").endswith(".py"))
    return scan.scan_files(f)[0].select("file", "line", "rule_id", "snippet", "analyzer")


_SQL["tree_findings_regex"] = f"WITH RECURSIVE {C.corpus_sql()}, {_RULES}, kind AS (SELECT * FROM corpus WHERE NOT ends_with(file, '.py') AND NOT {_IGNORED.format('file')} AND NOT {_PRUNED}), given AS (SELECT event_id AS id, file, line_num, text AS t FROM kind WHERE NOT {_ARTIFACT.format('file')}), {_hits('given')}" + f""" SELECT file, line_num AS line, rule_id, {_SNIP.format('t')} AS snippet, 'regex' AS analyzer FROM hits
  UNION ALL SELECT DISTINCT file, 0, 'MAL-BIN-ARTIFACT-001', 'Executable artifact detected: ' || string_split(file, '/')[-1], 'filesystem' FROM kind WHERE {_ARTIFACT.format('file')}"""


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that parse: the corpus's Python lines (templates 10, 11, 12, 25 and 28) alone."""
    c = C.corpus(spark, sf_dir).where(F.col("template").isin(10, 11, 12, 25, 28)).withColumn("text", F.trim("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "text"))), lambda x: x.text), "\n")
    return c.groupBy("file").agg(body.alias("content")).withColumn("file", F.concat("file", F.lit(".py")))


@_add
def ast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyast.syntax_findings(_python_files(spark, sf_dir)).select("file", "line", "column", F.coalesce("end_line", F.lit(-1)).alias("end_line"), F.coalesce("end_column", F.lit(-1)).alias("end_column"), "rule_id", "severity", "snippet")


_SQL["ast_findings"] = f"""WITH {C.corpus_sql()}, p AS (
  SELECT file || '.py' AS file, template, event_id, trim(text) AS t, CAST(row_number() OVER (PARTITION BY file ORDER BY line_num) AS INT) AS line FROM corpus WHERE template IN (10, 11, 12, 25, 28))
SELECT file, line, CAST(CASE template WHEN 11 THEN 0 ELSE instr(t, '=') + 1 END AS INT) AS "column", CAST(CASE template WHEN 10 THEN line ELSE -1 END AS INT) AS end_line, CAST(CASE template WHEN 10 THEN length(t) ELSE -1 END AS INT) AS end_column,
  CASE template WHEN 10 THEN 'PY-DYN-001' WHEN 11 THEN 'PY-CMD-001' ELSE 'PY-DESERIAL-001' END AS rule_id, 'HIGH' AS severity, {_SNIP.format('t')} AS snippet
FROM p WHERE template IN (10, 11, 12)"""


@_add
def tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree scan: names, syntax trees, and lines that no syntax-tree finding covers."""
    f = C.files(spark, sf_dir).unionByName(_python_files(spark, sf_dir))
    return scan.scan_files(f)[0].select("file", "line", "rule_id", "severity", "analyzer", "snippet")


# Files of the corpus that end in .py hold lines of all languages and can't be parsed; those of _python_files can.
_SQL["tree_findings"] = f"""WITH RECURSIVE {C.corpus_sql()}, {_RULES}, kind AS (SELECT * FROM corpus WHERE NOT {_IGNORED.format('file')} AND NOT {_PRUNED}),
p AS (SELECT * FROM (SELECT -1 - event_id AS id, file || '.py' AS file, template, trim(text) AS t, row_number() OVER (PARTITION BY file ORDER BY line_num) AS line FROM corpus WHERE template IN (10, 11, 12, 25, 28))
  WHERE NOT {_IGNORED.format('file')} AND NOT {_PRUNED}),
calls AS (SELECT id, file, line, t, CASE template WHEN 10 THEN 'PY-DYN-001' WHEN 11 THEN 'PY-CMD-001' ELSE 'PY-DESERIAL-001' END AS rule_id FROM p WHERE template IN (10, 11, 12)),
given AS (SELECT event_id AS id, file, line_num, text AS t FROM kind WHERE NOT {_ARTIFACT.format('file')} UNION ALL SELECT id, file, line, t FROM p), {_hits('given')}
SELECT file, CAST(line_num AS INT) AS line, rule_id, severity, 'regex' AS analyzer, {_SNIP.format('t')} AS snippet FROM hits WHERE NOT (family = 'language' AND id IN (SELECT id FROM calls))
UNION ALL SELECT file, CAST(line AS INT), rule_id, 'HIGH', 'python-ast', {_SNIP.format('t')} FROM calls
UNION ALL SELECT DISTINCT file, 0, 'MAL-BIN-ARTIFACT-001', 'CRITICAL', 'filesystem', 'Executable artifact detected: ' || string_split(file, '/')[-1] FROM kind WHERE {_ARTIFACT.format('file')}"""


@_add
def ast_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of call that the syntax-tree checks tell apart, nested ones too; every seventh file can't be parsed."""
    return pyast.syntax_findings(C.call_files(spark, sf_dir)).select("file", "line", "column", "rule_id", "severity", "confidence", "score")


_SQL["ast_branches"] = f"""WITH {C.calls_sql()}, said(template, mark, rule_id, severity, confidence, score) AS (VALUES {', '.join(f"({i}, {_lit(m)}, '{r}', '{v}', {k}, {n})" for i, (_, found) in enumerate(C.CALLS) for m, r, v, k, n in found)})
SELECT file, line, CAST(instr(t, mark) - 1 AS INT) AS "column", rule_id, severity, CAST(confidence AS DOUBLE) AS confidence, CAST(score AS DOUBLE) AS score FROM calls JOIN said USING (template) WHERE user_id % 7 <> 0"""


@_add
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests, one a file, as JSON texts and back to fixtures."""
    by = _labels(spark, sf_dir).groupBy("file").agg(F.sort_array(F.collect_set("rule_id")).alias("expected_rule_ids"))
    text = F.to_json(F.struct(F.array(F.struct("file", "expected_rule_ids", F.size("expected_rule_ids").alias("expected_count"))).alias("fixtures"), F.lit("x").alias("more")))
    return by.select(F.inline(tree.manifest(text))).withColumn("expected_rule_ids", F.array_join("expected_rule_ids", " "))


_SQL["manifest_rows"] = f"WITH RECURSIVE {C.corpus_sql()}, labels(template, rule_id) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, (ids, _) in enumerate(C.TEMPLATES) for r in ids if i != 4) + """, (28, 'GO-MEM-001'))
SELECT file, string_agg(rule_id, ' ' ORDER BY rule_id) AS expected_rule_ids, count(*) AS expected_count FROM (SELECT DISTINCT file, rule_id FROM corpus JOIN labels USING (template)) GROUP BY file"""


@_add
def event_pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a CI run as JSON: those about a pull request, and others."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    text = F.format_string('{"repository": {"full_name": "o%s/r"}, "action": [1, {}]%s}', "user_id", F.when(F.col("event_id") % 3 == 0, F.format_string(', "pull_request": {"number": %s, "x": null}', "event_id")).when(F.col("event_id") % 3 == 1, ', "pull_request": null').otherwise(""))
    at = tree.pull_request(text)
    return e.select("event_id", at["repository"].alias("repository"), at["number"].alias("number"))


_SQL["event_pull_requests"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'o' || user_id || '/r' END AS repository, CAST(CASE WHEN event_id % 3 = 0 THEN event_id END AS INT) AS number FROM events"


@_add
def chunk_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.select_chunks(_joined(spark, sf_dir), 1500)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of several files each: those of a name's ending and a tenth of the users."""
    d = C.diffs(spark, sf_dir).withColumn("group", F.regexp_extract("diff_id", r"u(\d?)\d*/", 1))
    return d.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("diff_id", "content"))), lambda x: x.content), "\n").alias("content")).withColumnRenamed("group", "diff_id")


_SQL["chunk_selection"] = f"""WITH RECURSIVE {C.corpus_sql()}, {_RULES}, signed AS (SELECT *, CASE template WHEN 28 THEN ' ' WHEN 25 THEN '-' ELSE '+' END AS sign FROM corpus), one AS (
  SELECT file, regexp_extract(file, 'u(\\d?)\\d*/', 1) AS g, 'diff --git a/' || file || ' b/' || file || chr(10) || '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -10,3 +11,9 @@' || chr(10)
    || string_agg(CASE WHEN line_num = 6 THEN '@@ -500,3 +501,9 @@' || chr(10) ELSE '' END || sign || text, chr(10) ORDER BY line_num) AS content FROM signed GROUP BY file
), whole AS (SELECT g, string_agg(content, chr(10) ORDER BY file) AS content FROM one GROUP BY g),
part AS (SELECT file, g, {_WS.format('content')} AS s FROM one),
flag AS (SELECT p.*, (SELECT bool_or(contains(split_part(p.s, chr(10), 1), c)) FROM unnest([{', '.join(map(_lit, chunk.CODE))}]) u(c)) OR EXISTS (SELECT 1 FROM rules r WHERE r.pattern IS NOT NULL AND regexp_matches(p.s, r.pattern)) AS pr FROM part p),
ranked AS (SELECT *, sum(length(s)) OVER (PARTITION BY g ORDER BY pr DESC, file) AS upto, row_number() OVER (PARTITION BY g ORDER BY pr DESC, file) AS no FROM flag),
taken AS (SELECT g, no, CASE WHEN upto <= 1500 THEN s ELSE substr(s, 1, CAST(1500 - (upto - length(s)) AS BIGINT)) || {_lit(chunk.CUT).replace(chr(10), "' || chr(10) || '")} END AS x FROM ranked WHERE upto <= 1500 OR 1500 - (upto - length(s)) > 200),
got AS (SELECT g, string_agg(x, chr(10) || chr(10) ORDER BY no) AS x FROM taken GROUP BY g)
SELECT w.g AS diff_id, CASE WHEN length(w.content) <= 1500 THEN w.content ELSE coalesce(got.x, substr(w.content, 1, 1500)) END AS "chunk" FROM whole w LEFT JOIN got ON got.g = w.g"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
