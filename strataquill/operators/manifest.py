"""File manifests of snapshots: classification, deltas, trees, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import paths


def manifest(files: DataFrame) -> DataFrame:
    """rel_path, language, category, size_bytes, est_lines, checksum of files (snapshot_id?, rel_path, content, size_bytes)."""
    keep = [c for c in ("snapshot_id", "mtime_ns") if c in files.columns]
    first = F.regexp_extract(F.coalesce(F.col("content"), F.lit("")), r"^[^\n]*", 0)
    return files.select(
        *keep, "rel_path", paths.language(F.col("rel_path"), first).alias("language"), paths.category(F.col("rel_path")).alias("category"),
        "size_bytes", F.floor(F.col("size_bytes") / 40).cast("long").alias("est_lines"), F.sha1(F.coalesce(F.col("content"), F.lit(""))).alias("checksum"),
    )


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """rel_path, change (new, changed, unchanged) of the current files by checksum, size and time of change; removed files
    aren't reported. Nulls are equal to nulls; a table without ``mtime_ns`` has null times."""
    parts = ["checksum", "size_bytes", "mtime_ns"]
    timed = lambda rows: rows if "mtime_ns" in rows.columns else rows.withColumn("mtime_ns", F.lit(None).cast("long"))
    old = timed(before).select("rel_path", F.struct(*parts).alias("old"))
    same = F.struct(*[F.col(p).cast("string") for p in parts]).eqNullSafe(F.struct(*[F.col("old")[p].cast("string").alias(p) for p in parts]))
    return timed(now).join(old, "rel_path", "left").select("rel_path", F.when(F.col("old").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("change"))


def delta_counts(changes: DataFrame, ignored: int = 0) -> DataFrame:
    one = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return changes.agg(F.count(F.lit(1)).alias("total"), one("new"), one("changed"), one("unchanged"), F.lit(ignored).cast("long").alias("ignored"))


def previous_snapshot(snapshots: DataFrame, current: str) -> DataFrame:
    """The latest snapshot of the same repository other than the current one."""
    own = snapshots.where(F.col("id") == current).select(F.col("local_repo_id").alias("__repo"), F.col("created_at").alias("__at"))
    others = snapshots.join(F.broadcast(own), F.col("local_repo_id") == F.col("__repo")).where(F.col("id") != current)
    return others.drop("__repo", "__at").orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def tree(files: DataFrame, limit: int | None = 5000) -> DataFrame:
    """path, is_dir, depth, place of distinct directories and files; ``place`` sorts them as a tree is shown, the entries of
    a directory behind it, directories first, then by name in any case."""
    nodes = files.select(F.explode(paths.ancestors(F.col("rel_path"))).alias("n")).select("n.path", "n.is_dir").distinct()
    parts = F.split("path", "/")
    # Every part but the last is a directory; a directory's mark sorts before a file's.
    marked = F.transform(parts, lambda p, i: F.concat(F.when((i < F.size(parts) - 1) | F.col("is_dir"), "0").otherwise("1"), F.lower(p), F.lit("\x01"), p))
    out = nodes.select("path", "is_dir", F.size(parts).cast("long").alias("depth"), F.array_join(marked, "\x02").alias("place"))
    return out if limit is None else out.orderBy("place").limit(limit)


def estimate_files(found: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """n_files that a scan would take in, and n_ignored, one row; ``found`` is a listing (rel_path)."""
    ignored = paths.is_ignored(F.col("rel_path"), patterns)
    return found.agg(F.count_if(~ignored).alias("n_files"), F.count_if(ignored).alias("n_ignored"))


def counts(files: DataFrame, by: str) -> DataFrame:
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


def preview(files: DataFrame, limit: int = 200) -> DataFrame:
    return files.orderBy("rel_path").limit(limit)


def visible(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Files that no ignore pattern covers."""
    return files.where(~paths.is_ignored(F.col("rel_path"), patterns))


def drop_snapshots(table: DataFrame, gone: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """A table without the rows of deleted snapshots."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, tuple[DataFrame, str, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """What stays of tables when rows of a parent are deleted, over any number of levels.

    ``tables``: name -> (rows, its own key, its parent's key column), parents before children by ``name``'s order; a table's
    parent is the one before whose key has that column's name, the first ones hang on ``gone`` by ``key``.
    """
    lost, kept = {key: gone.select(key).distinct()}, {}
    for name, (rows, own, parent) in tables.items():
        kept[name] = rows.join(lost[parent], parent, "left_anti")
        lost[own] = rows.join(lost[parent], parent, "left_semi").select(own).distinct()
    return kept


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A point update: rows with the columns of ``changes`` (key and some columns, one row per key) in place of their own."""
    columns = [c for c in changes.columns if c != key]
    found = changes.select(F.col(key).alias("__key"), F.struct(*columns).alias("__new"))
    joined = rows.join(found, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.when(F.col("__key").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def estimate_tokens(files: DataFrame) -> DataFrame:
    """The token estimate of an analysis run over the files."""
    n = F.count(F.lit(1))
    return files.agg(n.alias("n_files"), F.greatest(F.lit(1200).cast("long"), n * 220).alias("estimated_tokens"))
