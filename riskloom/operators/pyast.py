"""Syntax-tree checks of Python files: the one operator that needs Python on the executors."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.schemas import FIELDS, SYNTAX
from ..functions.text import snippet
from .match import TREE
from .rules import RULES

#: Method names that start a process whatever they are called on, and modules whose attributes are the built-in functions.
STARTS = ("Popen", "run", "call", "check_call", "check_output")
BUILTINS = ("builtins", "__builtin__")


def _is_name(node: ast.AST, *names: str) -> bool:
    return isinstance(node, ast.Name) and node.id in names


def call_findings(node: ast.Call) -> Iterator[tuple[str, str, float, float, str]]:
    """(rule, severity, confidence, score, description) of what a call does, eval first."""
    f = node.func
    attribute = f.attr if isinstance(f, ast.Attribute) else None
    name = f.id if isinstance(f, ast.Name) else attribute if attribute and _is_name(f.value, *BUILTINS) else None
    if attribute == "literal_eval" and _is_name(f.value, "ast"):
        return
    if name in ("eval", "exec"):
        fixed = bool(node.args) and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str)
        yield ("PY-DYN-001", "MEDIUM", 0.80, 5.0, f"A call of {name}() on constant text.") if fixed else ("PY-DYN-001", "HIGH", 0.99, 9.0, f"A call of {name}() on text made at run time.")
    if attribute and (_is_name(f.value, "subprocess") or attribute in STARTS):
        for k in node.keywords:
            if k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True:
                yield ("PY-CMD-001", "HIGH", 0.99, 9.5, "A process is started through a shell.")
    if attribute in ("load", "loads") and _is_name(f.value, "pickle"):
        yield ("PY-DESERIAL-001", "HIGH", 0.99, 9.8, "Unpickling can run any code.")


def calls(node: ast.AST) -> Iterator[ast.Call]:
    """All calls, each before those within it, without recursion."""
    todo = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Call):
            yield n
        todo.extend(reversed(list(ast.iter_child_nodes(n))))


def analyze(source: str) -> list[dict]:
    """Findings of one file, in the order of its calls. A file that can't be parsed has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rules, rows = {r.rule_id: r for r in RULES}, source.splitlines()
    out = []
    for node in calls(tree):
        for rule_id, severity, confidence, score, said in call_findings(node):
            r = rules[rule_id]
            ends = rule_id == "PY-DYN-001"
            out.append({
                "line": node.lineno, "column": node.col_offset, "end_line": node.end_lineno if ends else None, "end_column": node.end_col_offset if ends else None,
                "rule_id": rule_id, "title": r.title, "description": said, "severity": severity, "confidence": confidence, "category": r.category,
                "snippet": rows[node.lineno - 1].strip() if node.lineno <= len(rows) else "", "remediation": r.remediation, "cwe": r.cwe, "score": score, "seq": [TREE, len(out), 0],
            })
    return out


def is_python(path: Column) -> Column:
    return F.lower(path).rlike(r"\.pyw?$")


def syntax_calls(source: Column) -> Column:
    """The findings of each source, an empty array for null."""

    def run(sources: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([[] if x is None else analyze(x) for x in sources.to_pylist()], to_arrow_type(kind))

    kind = ArrayType(StructType.fromDDL(SYNTAX))
    return F.arrow_udf(run, kind)(source)


def syntax_findings(files: DataFrame) -> DataFrame:
    """Findings of the Python files among files (file, content). Snippets are masked and cut like all others."""
    found = files.where(is_python(F.col("file"))).select("file", F.explode(syntax_calls(F.col("content"))).alias("f")).select("file", "f.*")
    return found.withColumns({"snippet": snippet(F.col("snippet")), "evidence": F.lit(""), "language": F.lit("python"), "analyzer": F.lit("python-ast"), "cvss_vector": F.lit(None).cast("string"), "cvss_score": F.lit(None).cast("double"), "metadata": F.create_map().cast("map<string,string>")}).select(*FIELDS)
