"""Job and section events: slices by offset, latest status per key, and state machines, in batch and as streams.

An event is (job_id, seq, kind, key, status, value). The log only grows; consumers keep an offset, which the checkpoint of a
stream does for them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of a job, and those in which it has ended. (fixed values)
STATES = ("pending", "running", "done", "failed", "cancelled")
ENDED = ("done", "failed", "cancelled")


def offset_slice(events: DataFrame, job_col: str, job, seq_col: str, start: int) -> DataFrame:
    """A job's events from an offset on, in order."""
    return events.where((F.col(job_col) == job) & (F.col(seq_col) >= start)).orderBy(seq_col)


def latest_state(events: DataFrame, keys: list[str], status: str, seq: str) -> DataFrame:
    """The last status of each key, and how many events it has."""
    return events.groupBy(*keys).agg(F.max_by(status, seq).alias("status"), F.max(seq).alias("seq"), F.count(F.lit(1)).alias("n_events"))


def job_progress(steps: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Per job: steps done (100 percent), all steps, and the state that follows from them (job_id, step, percent, failed, seq);
    jobs in ``cancelled`` (job_id) that haven't ended are cancelled."""
    last = steps.groupBy("job_id", "step").agg(F.max_by("percent", "seq").alias("percent"), F.max("failed").alias("failed"))
    rows = last.groupBy("job_id").agg(F.count_if(F.col("percent") >= 100).alias("n_done"), F.count(F.lit(1)).alias("n_steps"), F.max("failed").alias("failed"))
    state = F.when(F.col("failed"), "failed").when(F.col("n_done") == F.col("n_steps"), "done").when(F.col("n_done") > 0, "running").otherwise("pending")
    if cancelled is None:
        return rows.select("job_id", "n_done", "n_steps", state.alias("state"))
    stopped = rows.join(cancelled.select("job_id", F.lit(True).alias("stopped")).distinct(), "job_id", "left")
    return stopped.select("job_id", "n_done", "n_steps", F.when(F.col("stopped") & ~state.isin(*ENDED), "cancelled").otherwise(state).alias("state"))


def stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The log as a stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_latest(events: DataFrame, keys: list[str], status: str, seq: str) -> DataFrame:
    """The fold of :func:`latest_state` as a stream; its state is kept."""
    return latest_state(events, keys, status, seq)


#: What a stream of folded events puts out.
FOLDED = "job_id string, key string, status string, seq long, n_events long, ended boolean"


def run_available(stream_rows: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there; each batch's rows are written below ``folder``, beside the stream's checkpoint,
    so what a consumer has read survives the driver. In complete mode the table is that of the last batch."""
    spark = stream_rows.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = stream_rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        out = spark.read.parquet(f"{folder}/rows")
    except AnalysisException:  # no batch
        return spark.createDataFrame([], stream_rows.schema)
    last = out.agg(F.max("batch")).scalar()
    return out.where(F.col("batch") == last).drop("batch") if mode == "complete" else out
