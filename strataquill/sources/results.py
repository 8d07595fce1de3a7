"""Results that are kept by what they were made from, so that asking again computes nothing.

A result is a table below ``folder/name/snapshot_id=.../key=...``; the key is a hash of its inputs and settings. A result with
another key of the same name and snapshot is out of date and goes when the new one is there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(files: DataFrame) -> str:
    """A hash of the files of a snapshot (rel_path, checksum), whatever their order; contents aren't read."""
    pair = F.xxhash64("rel_path", "checksum").cast("decimal(38,0)")
    other = F.xxhash64("checksum", "rel_path").cast("decimal(38,0)")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(pair).alias("a"), F.sum(other).alias("b")).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()[:24]


class Results:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _place(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self._conf)

    def get(self, name: str, snapshot_id: str, inputs: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name`` of a snapshot: the one that is kept, or ``make()``, which is then kept."""
        key = hashlib.sha256(json.dumps([inputs, settings], sort_keys=True, default=str).encode()).hexdigest()[:24]
        own, fs = self._place(name, f"snapshot_id={snapshot_id}", f"key={key}")
        # A table is whole when its writer has put its mark beside it.
        if not fs.exists(self._place(name, f"snapshot_id={snapshot_id}", f"key={key}", "_SUCCESS")[0]):
            make().write.mode("overwrite").parquet(own.toString())
            for other in fs.listStatus(own.getParent()):
                if other.getPath().getName() != own.getName():
                    fs.delete(other.getPath(), True)
        return self.spark.read.parquet(own.toString())

    def drop(self, snapshot_ids: list[str]) -> None:
        """Deletes all that is kept for snapshots."""
        top, fs = self._place()
        for name in fs.listStatus(top) if fs.exists(top) else ():
            for s in snapshot_ids:
                fs.delete(self._place(name.getPath().getName(), f"snapshot_id={s}")[0], True)
