"""Session helpers shared by every subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Settings of Spark, their defaults, and what Python on long texts gets instead.
BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, through Spark's reader only (any Hadoop file system works)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer splits than cores out to all of them; a table of more splits stays as it is.

    A small file of one row group is one split, and text work on it would else run on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once per application.

    The package is zipped on the driver and handed out by Spark's own file server, so neither a shared folder nor an
    installation on the nodes is needed. Python workers get ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` at a time unless
    the session says otherwise: texts are long, and a batch stands several times in memory.
    """
    for name, default, wanted in BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, wanted)
    sc = spark.sparkContext
    if getattr(sc, "_strataquill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="strataquill-")
    staged = os.path.join(folder, "src")
    shutil.copytree(here, os.path.join(staged, "strataquill"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "strataquill_pkg"), "zip", staged))
    shutil.rmtree(staged)
    sc._strataquill_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``, or the one that the context was given.

    Only where neither is set (tests, a laptop) a temporary folder is set instead.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    given = sc._jsc.sc().getCheckpointDir()
    if not given.isDefined():
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="strataquill-ckpt-"))
        given = sc._jsc.sc().getCheckpointDir()
    return named or given.get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data, on any Hadoop file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers outlive their tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files and checkpoints that nothing refers to any more.

    It acts on the garbage that the driver collects. The listeners' queues hold on to the last event, and with it to the
    plan of the last query, until another comes.
    """
    for last in (False, True):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not last:
            spark.range(1).count()


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Cuts the lineage at a reliable checkpoint, which survives the loss of executors.

    With ``free``, the shuffle files that only led to the checkpoint are released afterwards; for large shuffles that is
    worth the moment.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    if free:
        del df
        release(spark)
    return out


class Rounds:
    """The table of an iteration, written anew in each round below the shared folder; the one before it is deleted.

    Unlike a checkpoint, a table forgets how its rows were partitioned, which in loops of joins grows with every round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.last, self.n = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}", None, 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        if self.last:
            remove(self.spark, self.last)
        self.last, self.n = path, self.n + 1
        return self.spark.read.schema(df.schema).parquet(path)
