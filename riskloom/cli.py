"""The command line: `python -m riskloom --path TREE`, or a diff, or `benchmark MANIFEST`. Network access is left to the caller."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.diff import added_line_count
from .plans.evaluate import per_file, summary
from .plans.report import VERSION, Reports, ci_outputs, comment_body, write_ci_outputs
from .plans.scan import scan_diffs, scan_files, scan_tree
from .sources.config import load_config, threshold
from .sources.git import read_local_diff
from .sources.tree import read_event, read_manifest, read_tree

GATES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
HOOK = """repos:
  - repo: local
    hooks:
      - id: riskloom
        name: risk scan of what is staged
        entry: python -m riskloom --staged --strict
        language: system
        pass_filenames: false
"""


def _place(path: str | None) -> str | None:
    """Local paths are relative to where the command runs, not to where Spark does."""
    return os.path.abspath(path) if path and os.path.exists(path) else path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskloom", description="Scans source trees and diffs for secrets, malware and dangerous calls.")
    p.add_argument("--version", action="version", version=VERSION)
    what = p.add_argument_group("what is scanned")
    what.add_argument("--path", help="a file or a folder")
    what.add_argument("--diff", help="a file that holds a unified diff, or a folder of such files, wherever Spark reads")
    what.add_argument("--local", action="store_true", help="the changes of the working copy")
    what.add_argument("--staged", action="store_true", help="what is staged in the working copy")
    what.add_argument("--benchmark", metavar="MANIFEST", help="fixtures with the rules that are expected of them; paths are relative to --path")
    out = p.add_argument_group("reports")
    for name in ("sarif", "json", "html"):
        out.add_argument(f"--{name}", metavar="FILE")
    out.add_argument("--comment", metavar="FILE", help="the text of a comment on a pull request")
    out.add_argument("--badge", action="store_true", help="write security-badge.svg")
    out.add_argument("--event", metavar="FILE", help="the event of a CI run: reports are written, and outputs set, also without findings")
    out.add_argument("--quiet", action="store_true", help="say something only if there are findings")
    how = p.add_argument_group("how")
    how.add_argument("--config", help="settings, instead of the files that are looked for")
    how.add_argument("--strict", action="store_true", help="as --fail-on HIGH")
    how.add_argument("--fail-on", type=str.upper, choices=GATES, help="end with 1 if a finding is at least so severe")
    how.add_argument("--install-hook", action="store_true", help="write .pre-commit-config.yaml")
    return p


def install_hook(path: str = ".pre-commit-config.yaml") -> bool:
    """Whether the file was written; one that is there stays."""
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(HOOK)
    except FileExistsError:
        return False
    return True


def benchmark(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """One row: how findings in root agree with a manifest. Fixtures that are missing don't count."""
    fixtures = read_manifest(spark, manifest)
    files = read_tree(spark, root).join(fixtures.select("file"), "file", "left_semi").select("file", F.coalesce("content", F.lit("")).alias("content"))
    expected = fixtures.join(files.select("file"), "file", "left_semi").select("file", F.explode("expected_rule_ids").alias("rule_id"))
    return summary(per_file(scan_files(files, prune=False)[0], expected))


def _scan(spark: SparkSession, args: argparse.Namespace, ignore: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """Findings and lines_scanned of what the arguments name; None if there is nothing."""
    if args.path:
        return scan_tree(spark, args.path, ignore)
    if args.diff:
        diffs = spark.read.text(args.diff, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("content"))
    elif args.local or args.staged:
        diffs = read_local_diff(spark, staged=args.staged)
    else:
        return None
    return (scan_diffs(diffs, ignore), added_line_count(diffs)) if not diffs.isEmpty() else None


def _config(path: str | None) -> tuple[dict, list[str]]:
    config = load_config(path)
    ignore = config.get("ignore_paths")
    return config, ignore if isinstance(ignore, list) else []


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 1 if the gate fails or the settings are bad, 2 if a benchmark's manifest is not given, else 0."""
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["benchmark"]:
        argv = ["--benchmark", *argv[1:]]
    args = parser().parse_args(argv)
    args.path, args.diff, args.benchmark, args.event = map(_place, (args.path, args.diff, args.benchmark, args.event))
    say = (lambda *x: None) if args.quiet else print
    if args.install_hook:
        say("written" if install_hook() else "a hook file is there already")
        return 0
    try:
        config, ignore = _config(args.config)
    except (OSError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    least, begin = threshold(args.fail_on, args.strict, config), time.time()
    spark = spark or SparkSession.builder.appName("riskloom").getOrCreate()
    if args.benchmark:
        r = benchmark(spark, args.benchmark, args.path or ".").first()
        print(" ".join(f"{k}={r[k]}" for k in ("tp", "fp", "fn", "precision", "recall", "f1")))
        return 0 if r["passed"] else 1
    if args.event and (about := read_event(spark, args.event)):
        say(f"pull request {about[1]} of {about[0]}")
    got = _scan(spark, args, ignore)
    if got is None:
        say("Nothing to scan: name a path or a diff with changes.")
        return 0
    lines = got[1].first()
    made = Reports(got[0], lines["lines_scanned"] if lines else 0)
    try:
        # Counting ran the scan.
        made.ms = (time.time() - begin) * 1000
        return _report(made, args, least, say)
    finally:
        made.close()


def _report(made: Reports, args: argparse.Namespace, least: str | None, say) -> int:
    always = bool(args.event)
    if args.badge or always:
        say(made.write("badge", "security-badge.svg"))
    if made.total:
        print(made.markdown())
    else:
        say(f"Clean: {made.lines} lines in {made.ms:.2f} ms")
    for kind in ("sarif", "json", "html"):
        path = getattr(args, kind)
        if path and (made.total or always or kind == "html"):
            say(made.write(kind, path))
    if args.comment:
        with open(args.comment, "w", encoding="utf-8") as f:
            f.write(comment_body(made.markdown(), made.total > 0))
    if always:
        write_ci_outputs(ci_outputs(made.rows, args.sarif or "", args.html or ""))
    if made.fails(least):
        print(f"A finding is {least} or worse.", file=sys.stderr)
        return 1
    return 0
