"""The line search under Structured Streaming: it keeps no state, so a stream needs no watermark. This is an addition of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import lines
from ..operators.match import findings, match_lines
from ..operators.rules import RULES, Rule


def stream_findings(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of a stream of files (file, content)."""
    return findings(match_lines(lines(files, "content", "file"), rules), rules)
