"""Diffs of a working copy, by the git that is installed."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(folder: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, errors="replace", check=False)
    return done.stdout if done.returncode == 0 else ""


def local_diff(folder: str = ".", staged: bool = False) -> str:
    """What is staged; else the changes since the commit before the last, or if there are none, those that aren't staged. Empty where there is no repository."""
    if staged:
        return _git(folder, "diff", "--cached")
    since = _git(folder, "diff", "HEAD~1")
    return since if since.strip() else _git(folder, "diff")


def read_local_diff(spark: SparkSession, folder: str = ".", staged: bool = False) -> DataFrame:
    """One row (diff_id, content), or none if nothing changed."""
    text = local_diff(folder, staged)
    return spark.createDataFrame([(folder, text)] if text.strip() else [], "diff_id string, content string")
