"""Source files of a folder as a Spark data source: planned by size, pruned by pattern, in order, unreadable files as rows.

    tree.register(spark)
    spark.read.format("source_tree").option("patterns", "*.java,*.kt").load(folder)

Only names and sizes are listed where the read is planned; texts are read in tasks.  The folder must be one that all executors see.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files that one task reads, about; what opening a file counts as.
BYTES, OPENING = 64 << 20, 64 << 10
SCHEMA = "path string, size long, text string, error string"


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


def listed(root: str, patterns: list[str]) -> Iterator[tuple[str, int]]:
    """Path below the root with slashes, and size (-1 where it can't be told), of files whose name fits a pattern, in order of their paths.  Links
    to folders are not followed; a folder that can't be listed has no files."""
    for folder, below, names in os.walk(root, followlinks=False):
        below.sort()
        for name in names:
            if not patterns or any(fnmatch.fnmatchcase(name, p) for p in patterns):
                full = os.path.join(folder, name)
                try:
                    size = os.stat(full).st_size
                except OSError:
                    size = -1
                yield os.path.relpath(full, root).replace(os.sep, "/"), size


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.patterns = [p.strip() for p in options.get("patterns", "").split(",") if p.strip()]
        self.bytes = int(options.get("bytespertask", BYTES))

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for name, n in sorted(listed(self.root, self.patterns)):
            if held and size + n > self.bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append((name, n))
            size += max(n, 0) + OPENING
        return [*out, Files(held)] if held else out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name, size in partition.names:
            try:
                with open(os.path.join(self.root, name), "rb") as f:
                    text = f.read().decode("utf-8", errors="replace")
                yield name, size, text, None
            except OSError as e:
                yield name, size, None, e.strerror or type(e).__name__


class TreeSource(DataSource):
    """path, size, text, error: a row a file.  Bytes that are no UTF-8 are replaced; a file that can't be read has a null text and says why;
    an empty folder, or none, gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
