"""Sampled signals as rows: chunks, weighted overlap-add, statistics, the quality gate and interleaving.

Signals are rows (key columns, t, x). Which chunks cover a sample follows from
its index alone, so chunking generates rows and never joins on an inequality.
Covers WN1, WN2, WN6, JN8, AG4 to AG12, SC12, SC14, SC17.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import clipped


def stride_of(length: int, overlap: float) -> int:
    """Samples between chunk starts."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    return max(1, int((1 - overlap) * length))


def covering(t: Column, length: int, stride: int) -> Column:
    """Numbers of the chunks that hold sample t; chunk k starts at k * stride."""
    first = F.greatest(F.lit(0), F.ceil((t - F.lit(length - 1)) / F.lit(stride))).cast("bigint")
    return F.sequence(first, F.floor(t / F.lit(stride)).cast("bigint"))


def chunks(signal: DataFrame, length: int, stride: int, t: str = "t") -> DataFrame:
    """Each sample once per chunk: adds ``chunk`` and ``i``, the place in the chunk."""
    c = signal.select("*", F.explode(covering(F.col(t), length, stride)).alias("chunk"))
    return c.withColumn("i", (F.col(t) - F.col("chunk") * stride).cast("bigint"))


def triangle(i: Column, length: int) -> Column:
    """Integer triangular weight of place i; its greatest value cancels in an overlap-add."""
    return F.when(i < length // 2, i + 1).otherwise(F.lit(length) - i)


def weight(i: Column, length: int, power: float = 1.0) -> Column:
    """The weight as a share of the greatest, to a power."""
    return F.pow(triangle(i, length) / F.lit(float(length - length // 2)), F.lit(power))


def overlap_add(pieces: DataFrame, keys: list[str], y: Column, w: Column) -> DataFrame:
    """Sums of w * y and w for each sample: ``num``, ``den``. The value is num / greatest(den, 1e-8)."""
    return pieces.groupBy(*keys, "t").agg(F.sum(w * y).alias("num"), F.sum(w).alias("den"))


def chunk_sum(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the sum of x over each chunk; padding counts as zero."""
    return pieces.withColumn("chunk_sum", F.sum("x").over(Window.partitionBy(*keys, "chunk")))


def centred_overlap_add(signal: DataFrame, keys: list[str], length: int, stride: int) -> DataFrame:
    """Overlap-add of chunks freed of their mean, times ``length``: exact for integer samples."""
    pieces = chunk_sum(chunks(signal, length, stride), keys)
    return overlap_add(pieces, keys, F.col("x") * length - F.col("chunk_sum"), triangle(F.col("i"), length))


def shift_average(signal: DataFrame, keys: list[str], shifts: list[int], most: int, length: int, stride: int) -> DataFrame:
    """Mean over shifts of the overlap-add of the signal moved right by ``most - shift`` samples (and moved back)."""
    moved = signal.select("*", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"))
    moved = moved.withColumn("t", F.col("t") + most - F.col("shift"))
    out = centred_overlap_add(moved, [*keys, "shift"], length, stride)
    value = F.col("num") / F.greatest(F.col("den").cast("double"), F.lit(1e-8))
    return (
        out.withColumn("t", F.col("t") - most + F.col("shift"))
        .withColumn("value", value)
        .groupBy(*keys, "t")
        .agg(F.avg("value").alias("value"))
    )


def statistics(signal: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean and population standard deviation of each key."""
    return signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def normalise(signal: DataFrame, keys: list[str], eps: float = 1e-5) -> DataFrame:
    """x less its mean, over eps plus its deviation; the statistics are one row per key."""
    return signal.join(statistics(signal, keys), keys).withColumn("y", (F.col("x") - F.col("mean")) / (F.lit(eps) + F.col("std"))).drop("n")


def gate(master: DataFrame, parts: DataFrame, keys: list[str], flat: Column, every: int = 100) -> DataFrame:
    """Compares the sum of the parts with the master: rms ratio, uncentred cosine of every n-th sample, verdict.

    ``master`` and ``parts``: keys, t, x (``parts`` one row per slot). Samples
    count up to the shorter length. ``flat`` is the sample's place in the
    channel-major order. A silent master passes.
    """
    total = parts.groupBy(*keys, "t").agg(F.sum("x").alias("s"))
    both = master.join(total, [*keys, "t"])
    every_n = flat % every == 0
    part = lambda c: F.sum(F.when(every_n, c).otherwise(0.0))
    sums = both.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
        F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("stem_rms"),
        part(F.col("x") * F.col("s")).alias("ab"),
        part(F.col("x") * F.col("x")).alias("aa"),
        part(F.col("s") * F.col("s")).alias("bb"),
    )
    silent = F.col("rms") < 1e-5
    ratio = F.when(~silent, F.col("stem_rms") / F.col("rms"))
    cos = F.when(~silent, F.col("ab") / (F.sqrt("aa") * F.sqrt("bb") + F.lit(1e-12)))
    fails = F.isnan(cos) | (cos < 0.95) | (ratio < 0.55) | (ratio > 1.8)
    verdict = F.when(silent, "silent").when(fails, "failed").otherwise("passed")
    return sums.select(*keys, ratio.alias("ratio"), cos.alias("cos"), verdict.alias("verdict"))


def interleave(signal: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """One row per key and t with a column for each slot, shorter slots padded with zeros."""
    return signal.groupBy(*keys, "t").agg(
        *[clipped(F.max(F.when(F.col("slot") == s, F.col("x")))).alias(f"slot{s}") for s in range(slots)]
    )
