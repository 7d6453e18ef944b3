"""The application's log as rows (SRC4, SRC5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the line of a stored file, with title, path and offset.
STORED = (
    'Finished stem separation job for track "(.*?)" - result: successful: stem file stored to "(.*?)", with offset ([^,]+)'
)


def log_path(collection: str, app: str) -> str:
    """The log beside a collection."""
    return f"{collection.rsplit('/', 1)[0]}/Logs/{app}.log"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a log file; a missing file has none. Breaks lines at all characters that end one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "line_no bigint, line string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\R|[\x1c-\x1e]")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def entries(log: DataFrame) -> DataFrame:
    """(line_no, title, path, offset) of the lines that report a stored file."""
    hits = log.where(F.col("line").rlike(STORED))
    return hits.select("line_no", *[F.regexp_extract("line", STORED, i).alias(n) for i, n in ((1, "title"), (2, "path"), (3, "offset"))])
