"""Job state as an append-only log with a latest-per-path view, and the plan of outstanding work (SNK4, SNK5, SRC11, FLT8, FLT11, JN4, JN5)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, size bigint, mtime_ns bigint, status string, output_path string, error string, updated_at double, seq bigint"
#: The number of the last append of this process.
_last = 0
STATUSES = ("pending", "running", "done", "error")


def latest(jobs: DataFrame) -> DataFrame:
    """The last row of each path by ``seq``: a grouped maximum, so a path with many versions is combined on the map side."""
    rest = [c for c in jobs.columns if c != "path"]
    return jobs.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("j")).select("path", *[F.col(f"j.{c}").alias(c) for c in rest])


def done_current(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, size, mtime_ns) with ``done``: finished and unchanged since."""
    s = state.select("path", F.col("status").alias("s_status"), F.col("size").alias("s_size"), F.col("mtime_ns").alias("s_mtime"))
    same = (F.col("s_status") == "done") & (F.col("s_size") == F.col("size")) & (F.col("s_mtime") == F.col("mtime_ns"))
    return files.join(s, "path", "left").select(*files.columns, F.coalesce(same, F.lit(False)).alias("done"))


def pending(items: DataFrame, ready: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Items whose ``key`` is not among the ready ones; all of them with ``force``."""
    return items if force else items.join(ready.select(key), key, "left_anti")


def skipped(items: DataFrame, ready: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Items that need no work but still get their flag and state."""
    return items.limit(0) if force else items.join(ready.select(key), key, "left_semi")


class JobLog:
    """The log as a Parquet folder; each append is one commit, the view is always consistent."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def append(self, rows: DataFrame) -> None:
        """Upserts rows of the schema without ``seq``; later appends win, and of rows that repeat a path the latest ``updated_at``.

        ``seq`` is the time in nanoseconds, so that writers need not read the log.
        """
        global _last
        _last = max(_last + 1, time.time_ns())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names[:-1]], F.lit(_last).cast("bigint").alias("seq"))
        rest = F.struct(*[F.col(c) for c in names if c != "path"])
        order = F.struct(F.col("updated_at"), F.xxhash64("status", "size", "mtime_ns", "output_path", "error"))
        full = full.groupBy("path").agg(F.max_by(rest, order).alias("j")).select("path", "j.*")
        self.spark.createDataFrame([], SCHEMA).unionByName(full).write.mode("append").parquet(self.folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def latest(self) -> DataFrame:
        return latest(self.rows())

    def get(self, path: str) -> dict | None:
        row = latest(self.rows().where(F.col("path") == path)).first()
        return row.asDict() if row else None
