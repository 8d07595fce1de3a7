"""File trees as tables: a Python data source whose partitions are entries near the root, and readers for single files."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataquill.functions.paths import DEFAULT_IGNORES

SCHEMA = "rel_path string, size_bytes long, mtime_ns long, content string"
SNIFF = 2048


@dataclass
class Entry(InputPartition):
    name: str


LEAST_PARTS, DEEPEST = 64, 4


class TreeReader(DataSourceReader):
    """Walks one entry per partition. Directories near the root are split up until there are ``LEAST_PARTS`` entries, at most
    ``DEEPEST`` levels down. Ignored directories (anchored at the root) aren't entered."""

    def __init__(self, root: str, patterns: list[str]):
        self.root = root
        self.patterns = [*DEFAULT_IGNORES, *patterns]
        self.closed = [p[:-3] for p in self.patterns if p.endswith("/**")]

    def partitions(self) -> list[Entry]:
        entries = sorted(os.listdir(self.root))
        for _ in range(DEEPEST):
            folders = {n for n in entries if os.path.isdir(full := os.path.join(self.root, n)) and not os.path.islink(full)}
            if len(entries) >= LEAST_PARTS or not folders:
                break
            inside = [f"{n}/{x}" for n in sorted(folders) if self._open(n) for x in sorted(os.listdir(os.path.join(self.root, n)))]
            entries = [n for n in entries if n not in folders] + inside
        return [Entry(n) for n in entries] or [Entry("")]

    def _open(self, rel: str) -> bool:
        return not any(rel == c or rel.startswith(f"{c}/") for c in self.closed)

    def read(self, partition: Entry) -> Iterator[tuple]:
        if not partition.name:
            return
        todo = [partition.name]
        while todo:
            rel = todo.pop()
            full = os.path.join(self.root, rel)
            if os.path.isdir(full) and not os.path.islink(full):
                if self._open(rel):
                    todo += [f"{rel}/{n}" for n in sorted(os.listdir(full), reverse=True)]
            elif os.path.isfile(full) and not any(fnmatch.fnmatch(rel, p) for p in self.patterns):
                with open(full, "rb") as f:
                    head = f.read(SNIFF)
                    if not looks_binary(head):  # the rest of binary files isn't read
                        info = os.stat(full)
                        yield rel, info.st_size, info.st_mtime_ns, (head + f.read()).decode("utf-8", "ignore")


def looks_binary(head: bytes) -> bool:
    """A null byte, or not UTF-8; a character cut by the end of the sniffed bytes counts as not UTF-8."""
    if b"\0" in head:
        return True
    try:
        head.decode("utf-8")
    except UnicodeDecodeError:
        return True
    return False


class TreeSource(DataSource):
    """``spark.read.format("file_tree").option("path", root).option("ignores", "a/**,*.log").load()``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], [p.strip() for p in self.options.get("ignores", "").split(",") if p.strip()])


def read_tree(spark: SparkSession, root: str, ignores: list[str] | None = None) -> DataFrame:
    """Text files below a folder that all nodes see."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").option("path", root).option("ignores", ",".join(ignores or [])).load()


def read_binary(spark: SparkSession, root: str) -> DataFrame:
    """The same from any Hadoop file system: rel_path, size_bytes, content (invalid bytes dropped), is_binary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = files.select(F.col("path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))
    head = F.substring("raw", 1, SNIFF)
    text = F.replace(F.make_valid_utf8(F.col("raw").cast("string")), F.lit("\ufffd"), F.lit(""))
    binary = (F.position(F.lit(b"\0"), head) > 0) | ~F.is_valid_utf8(head.cast("string"))
    at = F.instr(F.col("path"), root.rstrip("/").removeprefix("file://"))
    return base.select(F.substr("path", at + len(root.rstrip("/").removeprefix("file://")) + 1).alias("rel_path"), "size_bytes", text.alias("content"), binary.alias("is_binary"))


def read_file(files: DataFrame, rel_path: str, max_chars: int = 200_000) -> DataFrame:
    """One file's content, cut to a length, and whether it was cut; a path that leaves the tree is an error."""
    if rel_path.startswith("/") or ".." in rel_path.split("/"):
        raise ValueError("the path leaves the tree")
    return files.where(F.col("rel_path") == rel_path).select("rel_path", F.substring("content", 1, max_chars).alias("content"), (F.char_length("content") > max_chars).alias("truncated"))


#: Folders that make a tree heavy. (fixed values)
HEAVY = ("node_modules", ".venv", "venv", "env", "target", "build", "dist")


def folder_record(root: str) -> dict:
    """What a folder is before it is taken in: path, exists, is_folder, readable, n_entries, is_repository."""
    there, folder = os.path.exists(root), os.path.isdir(root)
    readable = folder and os.access(root, os.R_OK | os.X_OK)
    names = os.listdir(root) if readable else []
    return {"path": os.path.abspath(root), "exists": there, "is_folder": folder, "readable": readable, "n_entries": len(names), "is_repository": ".git" in names}


def size_warning(entries: DataFrame, most: int = 200) -> DataFrame:
    """n_entries, n_heavy, warn of the root entries (name), one row."""
    rows = entries.agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("name").isin(*HEAVY)).alias("n_heavy"))
    return rows.withColumn("warn", (F.col("n_entries") > most) | (F.col("n_heavy") > 0))
