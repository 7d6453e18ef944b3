"""Streaming variants of the file scan and the job log (beyond the survey's parity list)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text
from ..operators.jobs import JobLog

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, root: str, per_batch: int = 3) -> DataFrame:
    """Audio files as they appear under ``root``, at most ``per_batch`` at a time."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_batch)
        .load(root)
    )
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(text.is_audio(F.col("path")))


def record(states: DataFrame, log: JobLog, checkpoint: str) -> DataStreamWriter:
    """Appends each micro-batch of job states to the log; later batches win."""
    return states.writeStream.foreachBatch(lambda df, _: log.append(df)).option("checkpointLocation", checkpoint)


def job_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per status and window of event time, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n"))
