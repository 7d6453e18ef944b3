"""Tables and files between the steps of a run, on a folder that driver and executors share.

A step that must not be computed twice, as its answer changes once outputs come
to exist, is written and read again; unlike a cache that holds when an executor
is lost.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a temporary folder where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="phonolith-run-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes each row's ``content`` to ``root`` and its ``name``; returns (name, size) of what was written.

    The folder must be of a kind that pyarrow opens. A task that runs again writes the same files again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                store.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"name": batch["name"], "size": [len(c) for c in batch["content"]]})

    return written(files.select("name", "content").mapInPandas(write, "name string, size long"), "files-written")
