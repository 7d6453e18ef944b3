"""File catalogs (SRC1, SRC2, SRC8, SRC9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import wav


def plain(path: str) -> Column:
    """A local file's path without the scheme; this source's paths are not escaped."""
    return F.regexp_replace(path, "^file:/*", "/").alias("path")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of the audio files at any depth below ``root``.

    Only names and sizes are read. Order by ``text.path_order`` where order counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(plain("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(text.is_audio(F.col("path")))


def contents(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path, content) of files by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(plain("path"), "content")


def wav_info(spark: SparkSession, root: str) -> DataFrame:
    """Headers of the WAV files below ``root``."""
    return contents(spark, root).select("path", wav.info(F.col("content")).alias("info")).select("path", "info.*")
