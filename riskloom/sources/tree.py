"""A tree of source files as a data source.

Spark's own file sources leave out names that begin with a dot or an underscore, which a scan must read. Folders are pruned and paths
ignored before they are opened. Planning lists folders only until there are enough of them; each of the others is a partition, listed by the
task that reads it. Options: path, ignore (globs, a JSON list), folders (how many are enough), batch (files of a partition, among those that
planning met).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.paths import ARTIFACTS, PRUNED, ignore_pattern

SCHEMA = "file string, name string, is_artifact boolean, content string"


class Found(NamedTuple):
    """A file: its path below the root, and where it is."""

    path: str
    full: str


class Tree:
    """What of a folder (or a file) is scanned. A root that doesn't exist has nothing."""

    def __init__(self, root: str, globs: list[str]):
        self.root = root
        self.pattern = re.compile(ignore_pattern(globs).replace("(?iu)", ""), re.IGNORECASE)

    def ignored(self, path: str) -> bool:
        return bool(self.pattern.search(re.sub("^b/", "", path.replace("\\", "/").strip())))

    def level(self, folder: str) -> tuple[list[Found], list[str]]:
        """A folder's own files, and its folders."""
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return [], []
        files = [Found(os.path.relpath(e.path, self.root).replace(os.sep, "/"), e.path) for e in entries if not e.is_dir()]
        inner = [e.path for e in entries if e.is_dir() and not e.is_symlink() and e.name not in PRUNED and not self.ignored(e.name)]
        return [f for f in files if not self.ignored(f.path)], inner

    def below(self, folder: str) -> Iterator[Found]:
        todo = [folder]
        while todo:
            files, inner = self.level(todo.pop())
            yield from files
            todo += reversed(inner)

    def planned(self, enough: int) -> tuple[list[Found], list[str]]:
        """Files met on the way to `enough` folders, and those folders."""
        if os.path.isfile(self.root):
            name = os.path.basename(self.root)
            return [] if self.ignored(name) else [Found(name, self.root)], []
        met, folders = [], [self.root]
        while folders and len(folders) < enough:
            levels = [self.level(f) for f in folders]
            met += [x for files, _ in levels for x in files]
            folders = [x for _, inner in levels for x in inner]
        return met, folders


def decode(data: bytes) -> str:
    """UTF-8 without what is malformed; carriage returns end lines like line feeds."""
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


class _Part(InputPartition):
    def __init__(self, files: list[Found], folder: str | None = None):
        self.files, self.folder = files, folder


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree = Tree(options["path"], json.loads(options.get("ignore", "[]")))
        self.batch, self.enough = int(options.get("batch", 500)), int(options.get("folders", 64))

    def partitions(self) -> list[InputPartition]:
        files, folders = self.tree.planned(self.enough)
        loose = [_Part(files[i : i + self.batch]) for i in range(0, len(files), self.batch)]
        return loose + [_Part([], f) for f in folders] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, full in self.tree.below(partition.folder) if partition.folder else partition.files:
            name = os.path.basename(full)
            if name.lower().endswith(ARTIFACTS):
                yield (path, name, True, None)
                continue
            try:
                with open(full, "rb") as f:
                    content = decode(f.read())
            except OSError:
                continue
            yield (path, name, False, content)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, path: str, ignore: list[str] | tuple[str, ...] = (), batch: int = 500, folders: int = 64) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(path=path, ignore=json.dumps(list(ignore)), batch=batch, folders=folders).load()


def manifest(text: Column) -> Column:
    """The fixtures of a manifest's JSON: an array of (file, expected_rule_ids, expected_count)."""
    return F.from_json(text, "fixtures array<struct<file: string, expected_rule_ids: array<string>, expected_count: bigint>>").getField("fixtures")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, expected_rule_ids, expected_count of each fixture of a manifest."""
    return spark.read.text(path, wholetext=True).select(F.inline(manifest(F.col("value"))))


def pull_request(payload: Column) -> Column:
    """(repository, number) of the pull request that an event's JSON is about; null for other events."""
    event = F.from_json(payload, "repository struct<full_name: string>, pull_request struct<number: int>")
    return F.when(event.pull_request.number.isNotNull(), F.struct(event.repository.full_name.alias("repository"), event.pull_request.number.alias("number")))


def read_event(spark: SparkSession, path: str) -> tuple[str, int] | None:
    row = spark.read.text(path, wholetext=True).select(pull_request(F.col("value")).alias("p")).first()
    return (row["p"]["repository"], row["p"]["number"]) if row and row["p"] else None
