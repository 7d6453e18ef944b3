"""The folder that driver and executors share, and tables written there to cut lineage.

A table written here survives lost executors, unlike a local checkpoint, and is
read back through Spark, so any store Spark can write will do.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: The tables of each ``working_tables`` that is open.
_open: list[list[tuple[SparkSession, str]]] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="phonolith-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/phonolith-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if _open:
        _open[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def working_tables() -> Iterator[None]:
    """Tables written inside are removed at the end, but those named by ``keep``: nothing may read the others later."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            _remove(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``written``, but not removed with the working tables around it."""
    now, _open[:] = list(_open), []
    try:
        return written(df, name)
    finally:
        _open[:] = now


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """The session sends Python about ``size`` bytes at a time from now on, or one row, where the default holds."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(size))


def collect_garbage(spark: SparkSession) -> None:
    """The driver's Python and its JVM give back what earlier steps held: plans, collected rows and broadcasts nobody reads.

    It goes back to the system: the JVM's heap shrinks until its least free share
    (``MinHeapFreeRatio``, else up to 70 % stay free), and both C libraries give up
    what they keep for later, most of it left by the JVM's compiler. Where a JVM
    or C library has no such call, that part is left out.
    """
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    jvm = spark._jvm
    with _free_share(jvm):
        jvm.System.gc()
    with suppress(Py4JError, PySparkException):
        _diagnostic(spark, "systemTrimNativeHeap")


def _diagnostic(spark: SparkSession, command: str) -> str:
    """What a diagnostic command of the driver's JVM says (``jcmd`` within the process)."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    kinds, values = new(jvm.Class, 4), new(jvm.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), command
    # The method of the interface: the server's own class is not exported.
    return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


@contextmanager
def _free_share(jvm) -> Iterator[None]:
    """Inside, a collection leaves no more of the heap free than it must."""
    name, before = "MaxHeapFreeRatio", None
    with suppress(Py4JError, PySparkException):
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        before = bean.getVMOption(name).getValue()
        bean.setVMOption(name, bean.getVMOption("MinHeapFreeRatio").getValue())
    try:
        yield
    finally:
        if before is not None:
            with suppress(Py4JError, PySparkException):
                bean.setVMOption(name, before)


def clean_shuffles(spark: SparkSession) -> None:
    """From now on the session removes a query's shuffle files when it ends, not when the driver's memory is next collected."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def join_hot(rows: DataFrame, unique: DataFrame, on: list[str], n: str, spread_by: list[str], hot: int = 1000, spread: int = 64) -> DataFrame:
    """``rows`` joined with the one row of ``unique`` for each key, also where a key holds a third of all rows.

    ``unique`` is a written table whose column ``n`` (dropped) counts the key's
    rows. Keys with over one in ``hot`` of all rows, ``hot`` keys at most, are
    dealt to ``spread`` tasks by a hash of ``spread_by``.
    """
    total = unique.agg(F.sum(n)).first()[0] or 0
    large = unique.where((F.col(n) * hot > total) & (F.col(n) > 4096)).select(*on, F.lit(True).alias("__hot"))  # fewer than ``hot`` rows
    if large.isEmpty():
        return rows.join(unique.drop(n), on)
    salted = rows.join(F.broadcast(large), on, "left")
    salted = salted.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread_by), F.lit(spread)).cast("int")).otherwise(0))
    each = F.explode(F.sequence(F.lit(0), F.when((F.col(n) * hot > total) & (F.col(n) > 4096), F.lit(spread - 1)).otherwise(0)))
    return salted.join(unique.withColumn("__salt", each).drop(n), [*on, "__salt"]).drop("__hot", "__salt")


def pieces_of(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
