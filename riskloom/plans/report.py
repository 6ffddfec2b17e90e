"""Findings as rows for people and tools: flat rows, counts, gate, Markdown, HTML, SARIF, JSON, badge, CI outputs."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.rules import RULES

VERSION = "1.0.0"


def finding_rows(findings: DataFrame, *keys: str) -> DataFrame:
    """The 17 flat columns that all reports read."""
    c = F.col
    return findings.select(
        *keys, "rule_id", "severity", c("title").alias("type"), "description", X.score_text(c("score")).alias("score"), X.confidence_text(c("confidence")).alias("confidence"),
        X.location(c("file"), c("line"), c("column")).alias("file"), "snippet", "category", "analyzer", F.coalesce("cwe", F.lit("")).alias("cwe"), F.coalesce("remediation", F.lit("")).alias("remediation"),
        "line", "column", "cvss_vector", "cvss_score", "metadata",
    )


def split_location(file: Column) -> tuple[Column, Column]:
    """(path, line or null) by the last colon, if a number follows it."""
    number = F.regexp_extract(file, r"^(.*):\s*([+-]?\d+)\s*$", 2)
    split = file.contains(":") & ~file.startswith("http") & (number != "")
    return F.when(split, F.regexp_extract(file, r"^(.*):([^:]*)$", 1)).otherwise(file), F.when(split, number.try_cast("int"))


def from_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Flat rows back to findings. Columns that are missing get the defaults of a general finding."""
    has = lambda n, d: F.coalesce(F.col(n), d) if n in rows.columns else d
    text = lambda n, d: has(n, F.lit(d)).cast("string")
    path, line = split_location(text("file", "diff"))
    given = text("confidence", "0.95")
    percent = F.regexp_replace(given, "%", "").try_cast("double")
    confidence = F.when(given.contains("%"), F.coalesce(percent / 100, F.lit(0.95))).otherwise(F.coalesce(F.when(percent <= 1, percent).otherwise(percent / 100), F.lit(0.95)))
    known = sorted({r.category for r in RULES} | {"general"})
    return rows.select(
        *keys, text("rule_id", "GEN-001").alias("rule_id"), has("type", F.lit("Security Finding")).alias("title"), has("description", has("type", F.lit(""))).alias("description"),
        X.severity_of(text("severity", "LOW")).alias("severity"), confidence.alias("confidence"), F.when(text("category", "general").isin(known), text("category", "general")).otherwise("general").alias("category"),
        path.alias("file"), F.coalesce(line, has("line", F.lit(0)).cast("int")).alias("line"), has("column", F.lit(None).cast("int")).alias("column"), text("snippet", "").alias("snippet"),
        text("analyzer", "regex").alias("analyzer"), F.coalesce(text("score", "0").try_cast("double"), F.lit(0.0)).alias("score"),
    )


def counts(rows: DataFrame) -> DataFrame:
    """total, critical, high: one row."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))


def gates(rows: DataFrame, leasts: Sequence[str | None], *keys: str) -> DataFrame:
    """least, fail (of each of keys): whether a finding is at least as severe as each of `leasts`. Without a threshold, or findings, none is."""
    worst = rows.groupBy(*keys).agg(F.max(X.severity_rank(F.col("severity"))).alias("worst"))
    fails = lambda x: F.coalesce(F.col("worst") >= X.severity_rank(F.lit(x), unknown=3), F.lit(False)) if x else F.lit(False)
    return worst.select(*keys, F.inline(F.array(*[F.struct(F.lit(x).cast("string").alias("least"), fails(x).alias("fail")) for x in leasts])))


def gate(rows: DataFrame, least: str | None, *keys: str) -> DataFrame:
    """fail: whether a finding (of each of keys) is at least as severe as `least`."""
    return gates(rows, [least], *keys).drop("least")


def ci_outputs(rows: DataFrame, sarif: str = "", html: str = "") -> DataFrame:
    """name, value of each output of a CI step."""
    one = rows.agg(F.count(F.lit(1)).cast("string").alias("n"), F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).cast("string").alias("c"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("findings-count", F.col("n")), ("has-critical", F.col("c")), ("sarif-path", F.lit(sarif)), ("html-report-path", F.lit(html)))])))


def write_ci_outputs(outputs: DataFrame, path: str | None = None) -> None:
    path = path or os.environ.get("GITHUB_OUTPUT")
    if path:
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(f"{r['name']}={r['value']}\n" for r in outputs.collect())


# The texts of the Markdown table and its status lines, which readers and other tools look for.


def markdown_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """A table row for each finding; only CRITICAL has a label of its own."""
    label = F.when(F.col("severity") == "CRITICAL", "🔴 `CRITICAL`").otherwise("🟠 `HIGH`")
    return rows.select(*keys, F.format_string("| %s | %s | `%s` | **%s** | %s | `%s` |", label, "type", "rule_id", "score", "confidence", "snippet").alias("row"))


def markdown(rows: Iterable[str], lines_scanned: int = 0, ms: float = 0.0, total: int | None = None) -> str:
    """The table of rows; of `total` findings these may be the first ones, which it says then."""
    rows = list(rows)
    total = len(rows) if total is None else total
    head = f"⚡ **Scan Metrics:** Scanned `{lines_scanned}` lines in `{ms:.2f}ms` | Findings: `{total}`\n\n"
    if not total:
        return head + "✅ **Security Status:** No vulnerabilities or secret leaks detected."
    more = [f"\n{total - len(rows)} more findings are in the tables beside this page."] if total > len(rows) else []
    return head + "\n".join(["| Severity | Vulnerability Type | Rule ID | Score | Confidence | Code Snippet |", "| :--- | :--- | :---: | :---: | :---: | :--- |", *rows, *more]) + "\n"


def comment_body(summary: str, has_issues: bool, sections: tuple[str, ...] = (), name: str = "riskloom") -> str:
    """What a comment on a pull request says: a status, the summary table, and more sections."""
    status = "ISSUES FOUND" if has_issues else "PASSED"
    parts = [f"**{status}**", f"### Security report of {name} {VERSION}", "#### 📊 Security Summary\n" + summary, *sections]
    return "\n\n".join(parts) + f"\n\n---\n*Made by {name}*"


def html_rows(rows: DataFrame, *keys: str) -> DataFrame:
    kind = F.when(F.upper("severity") == "CRITICAL", "critical").when(F.upper("severity") == "HIGH", "high").otherwise("medium")
    cell = lambda n: F.concat(F.lit("<td>"), X.escape_html(F.col(n)), F.lit("</td>"))
    return rows.select(*keys, F.concat(F.lit('<tr class="'), kind, F.lit('" data-severity="'), X.escape_html(F.upper("severity")), F.lit('">'), *[cell(n) for n in ("severity", "rule_id", "type", "file", "score", "confidence", "snippet")], F.lit("</tr>")).alias("row"))


def html(rows: list[str], total: int, critical: int, high: int, lines_scanned: int = 0, ms: float = 0.0) -> str:
    """A page with counts, filter buttons and a search field over the rows."""
    cards = "".join(f"<div class=card><b>{n}</b> {name}</div>" for name, n in (("findings", total), ("critical", critical), ("high", high), ("lines", lines_scanned), ("ms", f"{ms:.2f}")))
    buttons = "".join(f"<button onclick=\"pick('{x}')\">{x}</button>" for x in ("ALL", "CRITICAL", "HIGH"))
    script = "let kind='ALL';function pick(k){kind=k;show()}function show(){const q=document.getElementById('q').value.toLowerCase();document.querySelectorAll('tbody tr').forEach(r=>{r.hidden=!((kind==='ALL'||r.dataset.severity===kind)&&r.textContent.toLowerCase().includes(q))})}"
    head = "".join(f"<th>{x}</th>" for x in ("Severity", "Rule", "Type", "Place", "Score", "Confidence", "Snippet"))
    return f"<!doctype html><html><head><meta charset=utf-8><title>Risk report</title></head><body>{cards}{buttons}<input id=q oninput=show()><table><thead><tr>{head}</tr></thead><tbody>{''.join(rows)}</tbody></table><script>{script}</script></body></html>"


def sarif_level(severity: Column) -> Column:
    return F.when(F.upper(severity).isin("CRITICAL", "HIGH"), "error").when(F.upper(severity) == "MEDIUM", "warning").otherwise("note")


def sarif_results(findings: DataFrame, *keys: str) -> DataFrame:
    """rule_id, level, message, uri, start_line of each finding; path and line come from their own columns."""
    return findings.select(*keys, "rule_id", sarif_level(F.col("severity")).alias("level"), F.concat("title", F.lit(": "), "snippet").alias("message"), F.translate("file", "\\", "/").alias("uri"), F.greatest(F.lit(1), "line").alias("start_line"))


def sarif_rules() -> list[dict]:
    """All rules, met or not."""
    text = lambda r: f"{r.description}\n\nRemediation: {r.remediation}\n" + (f"CWE: {r.cwe}\n" if r.cwe else "")
    return [{"id": r.rule_id, "name": r.title, "shortDescription": {"text": r.title}, "fullDescription": {"text": r.description}, "help": {"text": text(r)}, "properties": {"category": r.category, "cwe": r.cwe or "", "security-severity": str(r.score)}} for r in RULES]


def sarif_json(results: DataFrame, *keys: str) -> DataFrame:
    """The results as JSON texts, made on the executors."""
    place = F.struct(F.struct(F.struct(F.col("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    whole = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return results.select(*keys, F.to_json(whole).alias("json"))


def _sarif_frame() -> tuple[str, str]:
    """What stands before and after the results of a SARIF 2.1.0 document."""
    driver = {"name": "riskloom", "version": VERSION, "rules": sarif_rules()}
    frame = {"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": ["HERE"]}]}
    before, after = json.dumps(frame, indent=2).split('"HERE"')
    return before, after


def sarif(results: DataFrame) -> str:
    """One document with all results, for few of them."""
    return "".join(_document(*_sarif_frame(), (r["json"] for r in sarif_json(results).toLocalIterator())))


def sarif_documents(findings: DataFrame, most: int = 5000) -> DataFrame:
    """part, number, document: SARIF documents of at most `most` results each, made by the tasks that hold them. `write.text` stores them."""
    before, after = (F.lit(x) for x in _sarif_frame())
    placed = sarif_json(sarif_results(findings)).withColumn("id", F.monotonically_increasing_id())
    part, number = F.shiftright("id", 33).alias("part"), F.floor(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) / most).alias("number")
    by = placed.groupBy(part, number).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "json"))), lambda x: x["json"]), ",\n").alias("body"))
    return by.select("part", "number", F.concat(before, "body", after).alias("document"))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def to_json_array(rows: DataFrame) -> str:
    """All rows as one JSON array, for few of them. For many, json_rows(rows).write.text is the sink."""
    return "".join(_document("[\n", "\n]", (r["json"] for r in json_rows(rows).toLocalIterator())))


def _document(before: str, after: str, items: Iterator[str]) -> Iterator[str]:
    """A JSON document in pieces, one item after the other."""
    yield before
    for i, x in enumerate(items):
        yield x if i == 0 else ",\n" + x
    yield after


# The colours and the two states of the badge.
_BADGE = {True: ("#e05d44", "issues found"), False: ("#4c1", "passed")}


def badge(has_issues: bool) -> str:
    colour, said = _BADGE[has_issues]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="140" height="20"><rect width="90" height="20" fill="#555"/><rect x="90" width="50" height="20" fill="{colour}"/><g fill="#fff" text-anchor="middle" font-family="Verdana,sans-serif" font-size="11"><text x="45" y="14">security audit</text><text x="115" y="14">{said}</text></g></svg>'


def _write(path: str, pieces: Iterable[str]) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(pieces)
    return path


#: Rows that the two pages for people show.
SHOWN = 10_000
REPORTS = ("badge", "markdown", "html", "sarif", "json")
NAMES = {"badge": "badge.svg", "markdown": "summary.md", "html": "report.html", "sarif": "results.sarif", "json": "findings.json"}


class Reports:
    """The reports on findings, whose scan runs once: they are kept on the executors' disks until `close`.

    Pages for people show the first `shown` rows in order of place, and say how many more there are. SARIF and JSON documents hold all, and are
    written one finding after the other, so the driver holds one partition of them at most.
    """

    def __init__(self, findings: DataFrame, lines_scanned: int = 0, ms: float = 0.0, shown: int = SHOWN):
        self.findings = findings.persist(StorageLevel.DISK_ONLY)
        self.lines, self.ms, self.shown = lines_scanned, ms, shown
        n = counts(self.findings).first()
        self.total, self.critical, self.high = n["total"], n["critical"], n["high"]
        self.rows = finding_rows(self.findings, "seq")

    def _first(self) -> DataFrame:
        return self.rows.orderBy("file", "seq", "rule_id").limit(self.shown)

    def markdown(self) -> str:
        return markdown((r["row"] for r in markdown_rows(self._first()).collect()), self.lines, self.ms, self.total)

    def write(self, kind: str, path: str) -> str:
        if kind == "badge":
            return _write(path, [badge(self.total > 0)])
        if kind == "markdown":
            return _write(path, [self.markdown()])
        if kind == "html":
            rows = [r["row"] for r in html_rows(self._first()).collect()]
            return _write(path, [html(rows, self.total, self.critical, self.high, self.lines, self.ms)])
        ordered = self.findings.orderBy("file", "seq", "rule_id")
        if kind == "sarif":
            before, after = _sarif_frame()
            items = sarif_json(sarif_results(ordered))
        else:
            before, after = "[\n", "\n]"
            items = json_rows(finding_rows(ordered))
        return _write(path, _document(before, after, (r["json"] for r in items.toLocalIterator())))

    def fails(self, least: str | None) -> bool:
        return gate(self.rows, least).first()["fail"]

    def close(self) -> None:
        self.findings.unpersist()


def write_reports(findings: DataFrame, folder: str, lines_scanned: int = 0, ms: float = 0.0, even_if_clean: bool = False, shown: int = SHOWN) -> dict[str, str]:
    """Badge, Markdown and HTML always; SARIF and JSON if there are findings, or even_if_clean. Returns what was written where."""
    made = Reports(findings, lines_scanned, ms, shown)
    try:
        kinds = [k for k in REPORTS if made.total or even_if_clean or k not in ("sarif", "json")]
        return {NAMES[k]: made.write(k, os.path.join(folder, NAMES[k])) for k in kinds}
    finally:
        made.close()


def write_tables(findings: DataFrame, folder: str) -> None:
    """For many findings: JSON lines and SARIF documents, written by the executors to any file system."""
    json_rows(finding_rows(findings)).write.text(f"{folder}/findings")
    sarif_documents(findings).select("document").write.text(f"{folder}/sarif", lineSep="\n\n")
