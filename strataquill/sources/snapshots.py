"""Tables of snapshots as Parquet partitioned by snapshot_id: replace, append, insert if absent, drop."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.operators.manifest import keep_first
from strataquill.session import cut


def replace(rows: DataFrame, path: str) -> None:
    """Replaces the partitions of the snapshots that occur in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("snapshot_id").parquet(path)


def read(spark: SparkSession, path: str, snapshot_id: str | None = None) -> DataFrame:
    """A table, or one snapshot of it (only its partition is read)."""
    rows = spark.read.parquet(path)
    return rows if snapshot_id is None else rows.where(F.col("snapshot_id") == snapshot_id)


def insert_absent(rows: DataFrame, path: str, keys: list[str], order: list) -> None:
    """Appends the rows whose keys the table lacks, the first of each key."""
    spark = rows.sparkSession
    new = keep_first(rows, keys, order)
    try:
        known = spark.read.parquet(path).select(*keys)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        new = cut(new.join(known, keys, "left_anti"))
    append(new, path)


def built(spark: SparkSession, path: str, snapshot_id: str) -> bool:
    """Whether a table has rows of a snapshot."""
    try:
        return not read(spark, path, snapshot_id).isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


#: Columns of the tables, by version of the layout; a new version adds tables or columns, which read as null before. (fixed values)
LAYOUTS = {
    1: {
        "files": "rel_path string, size_bytes long, content string, language string, category string, checksum string, snapshot_id string",
        "symbols": "rel_path string, language string, name string, kind string, line_start long, line_end long, signature string, parent_name string, extract_source string, snapshot_id string",
        "edges": "src_path string, dst_path string, edge_type string, is_external boolean, snapshot_id string",
        "communities": "rel_path string, community_id long, snapshot_id string",
        "chunks": "rel_path string, category string, language string, chunk_index long, content string, token_estimate long, snapshot_id string",
        "terms": "rel_path string, chunk_index long, dl long, term string, f long, snapshot_id string",
        "symbol_edges": "src_symbol string, dst_symbol string, edge_type string, confidence string, line long, snapshot_id string",
    },
    2: {"files": "rel_path string, size_bytes long, content string, language string, category string, checksum string, mtime_ns long, snapshot_id string"},
}


def layout(version: int | None = None) -> dict[str, str]:
    """The columns of all tables in a version, by default the newest."""
    out: dict[str, str] = {}
    for v in sorted(LAYOUTS):
        if version is None or v <= version:
            out |= LAYOUTS[v]
    return out


def read_as(spark: SparkSession, path: str, columns: str, snapshot_id: str | None = None) -> DataFrame:
    """A table with the columns of a layout: those that its files lack are null, and a table that isn't there is empty."""
    try:
        rows = spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], columns)
    return rows if snapshot_id is None else rows.where(F.col("snapshot_id") == snapshot_id)


def config_value(config: DataFrame, key: str, default: str | None = None) -> str | None:
    """A value of a table of settings (key, value)."""
    row = config.where(F.col("key") == key).select("value").first()
    return default if row is None or row["value"] is None else row["value"]


def belongs(table: DataFrame, snapshot_id: str, repo_id: str) -> bool:
    """Whether a snapshot (id, local_repo_id) is one of a repository."""
    return not table.where((F.col("id") == snapshot_id) & (F.col("local_repo_id") == repo_id)).isEmpty()


def drop(spark: SparkSession, path: str, snapshot_ids: list[str]) -> None:
    """Deletes the partitions of snapshots through the file system that holds the table."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for s in snapshot_ids:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot_id={s}")
        folder.getFileSystem(conf).delete(folder, True)
