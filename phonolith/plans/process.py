"""Whole runs over a library: scan, choose outputs, plan, separate, check, write and record.

The catalog part is one DataFrame plan. Signals travel as one row per block of
samples; neighbouring blocks meet in windows over one track and channel, so a
track of any length takes a few blocks of memory.
"""

from __future__ import annotations

import os
import time
import wave
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CollectionError, LibraryError
from ..functions import mp4, naming, text
from ..operators import catalog, jobs, separate, signal
from ..sources import collection, files, logs, scratch, wav
from ..views import view

#: Only PCM is written; the others name what a plan asks of an encoder.
CODECS = ("pcm", "aac", "alac")
PROFILES = {"silent": 4, "ultra": 12, "extreme": 8, "balanced": 8}


@dataclass
class Settings:
    """Settings of a run; ``check`` reports the first one out of range."""

    music_dir: str
    output_dir: str
    collection: str | None = None
    log: str | None = None
    state_dir: str | None = None
    model: str = "linear-stand-in"
    algorithm: str = naming.ALGORITHM
    batch_size: int = 0
    profile: str = "ultra"
    overlap: float = 0.1
    segment: float = 7.8
    sample_rate: int = 44100
    codec: str = "pcm"
    bitrate: int = 256_000
    shifts: int = 0
    limit: int = 0
    force: bool = False
    reprocess_existing: bool = False
    dry_run: bool = False
    update_collection: bool = True
    continue_on_error: bool = False
    #: Where the collection is looked for if none is named, and the name of its application.
    library_root: str | None = None
    library_app: str | None = None

    def located(self, spark: SparkSession) -> Settings:
        """With the collection and the log that are meant where none is named: the newest one, and the log beside it."""
        found = self.collection
        if found is None and self.library_root and self.library_app:
            found = collection.discover(spark, self.library_root, self.library_app)
            if found is None:
                raise CollectionError(f"no collection of {self.library_app} below {self.library_root}")
        log = self.log
        if log is None and found and self.library_app:
            log = logs.log_path(found, self.library_app)
        return replace(self, collection=found, log=log)

    def check(self) -> Settings:
        naming.known(self.algorithm)
        for ok, what in (
            (0 <= self.overlap < 1, "overlap must be at least 0 and below 1"),
            (self.batch_size >= 0, "batch size must be 0 (automatic) or more"),
            (self.limit >= 0, "limit must be 0 (all) or more"),
            (self.shifts >= 0, "shifts must be 0 or more"),
            (self.segment > 0, "segment must be above 0"),
            (self.sample_rate > 0, "sample rate must be above 0"),
            (self.bitrate > 0, "bitrate must be above 0"),
            (self.model in separate.known(), f"model must be one of {', '.join(separate.known())}"),
            (self.codec in CODECS, f"codec must be one of {', '.join(CODECS)}"),
            (self.profile in PROFILES, f"profile must be one of {', '.join(PROFILES)}"),
        ):
            if not ok:
                raise LibraryError(what)
        return self


def flagship(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """The first tracks in path order with their collection values and output paths."""
    entries = view(spark, sf_dir, "v_collection").withColumn("path", text.collection_path(F.col("dir_value"), F.col("file_value")))
    enriched = catalog.enrich(catalog.tracks(view(spark, sf_dir, "v_files")), catalog.collection_index(entries))
    first = enriched.where(F.col("audio_id").isNotNull()).orderBy(text.path_order(F.col("path"))).limit(limit)
    logged = spark.createDataFrame([], "title string, logged_path string")
    return catalog.output_paths(first.select("path", "title", "artist", "audio_id"), logged, "/Outputs")


def scanned(spark: SparkSession, s: Settings) -> DataFrame:
    """path, size, mtime_ns, title, artist, audio_id of the library's tracks."""
    found = catalog.tracks(files.scan(spark, s.music_dir))
    found = found.withColumn("mtime_ns", F.unix_micros("modified") * 1000).drop("modified")
    if s.collection is None:
        return found.withColumn("audio_id", F.lit(None).cast("string"))
    return catalog.enrich(found, catalog.collection_index(collection.read_ordered(spark, s.collection)))


def planned(spark: SparkSession, s: Settings) -> DataFrame:
    """Tracks with ``output`` or ``error``, in path order up to the limit."""
    tracks = scanned(spark, s)
    if s.limit:
        tracks = tracks.orderBy(text.path_order(F.col("path"))).limit(s.limit)
    log = logs.entries(logs.lines(spark, s.log)) if s.log else spark.createDataFrame([], "line_no bigint, title string, path string, offset string")
    return catalog.output_paths(tracks, catalog.latest_logged(log, s.output_dir), s.output_dir)


def pcm_path(output: str) -> str:
    """Where the PCM stand-in of a container is written: no encoder ships here."""
    return output.removesuffix(".mp4") + ".wav"


#: Stands before the metadata in the PCM stand-in: a chunk that readers of samples pass over.
_CHUNK = b"slot"


def _ready(output: str | None) -> bool:
    """Whether a whole file of five stereo streams with its slot metadata is there: cheap tests first."""
    path = pcm_path(output or "")
    try:
        with wave.open(path, "rb") as w:
            if w.getnchannels() != 2 * len(mp4.SLOTS) or not w.getnframes():
                return False
        expected = _metadata_chunk()
        with open(path, "rb") as f:
            f.seek(-len(expected), os.SEEK_END)
            return f.read() == expected
    except (OSError, EOFError, wave.Error):
        return False


def _metadata_chunk() -> bytes:
    text = mp4.metadata_json().encode()
    return _CHUNK + len(text).to_bytes(4, "little") + text + b"\0" * (len(text) % 2)


def _add_metadata(path: str) -> None:
    """Puts the metadata behind the samples of a written file."""
    with open(path, "r+b") as f:
        f.seek(0, os.SEEK_END)
        f.write(_metadata_chunk())
        size = f.tell()
        f.seek(4)
        f.write((size - 8).to_bytes(4, "little"))


def ready(outputs: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(_ready).astype(bool)

    return run(outputs)


def chunked(blocks: DataFrame, length: int, stride: int) -> DataFrame:
    """Chunks of ``length`` from blocks of ``stride`` samples: a block and what follows it."""
    more = -(-length // stride) - 1
    ahead = Window.partitionBy("path", "channel").orderBy("block").rowsBetween(0, more)
    joined = F.slice(F.flatten(F.collect_list("samples").over(ahead)), 1, length)
    return blocks.select("path", "sample_rate", "channel", F.col("block").alias("chunk"), joined.alias("samples"))


def reassembled(parts: DataFrame, length: int, stride: int) -> DataFrame:
    """Weighted overlap-add of separated chunks, back to blocks of ``stride`` samples."""
    more = -(-length // stride) - 1
    back = Window.partitionBy("path", "channel", "slot").orderBy("chunk").rowsBetween(-more, 0)
    i = np.arange(length)
    weights = np.where(i < length // 2, i + 1, length - i) / (length - length // 2)

    @F.pandas_udf("array<double>")
    def add(lists: pd.Series) -> pd.Series:
        out = []
        for chunks in lists:
            n = min(stride, len(chunks[-1]))
            total, norm = np.zeros(n), np.zeros(n)
            for distance, chunk in enumerate(reversed(list(chunks))):
                at = distance * stride
                y = np.asarray(chunk, float)[at : at + n]
                total[: len(y)] += weights[at : at + len(y)] * y
                norm[: len(y)] += weights[at : at + len(y)]
            out.append((total / np.maximum(norm, 1e-8)).tolist())
        return pd.Series(out)

    chunks = F.collect_list("samples").over(back)
    return parts.withColumn("chunks", chunks).select("path", "sample_rate", "channel", F.col("chunk").alias("block"), "slot", add("chunks").alias("samples"))


def checked(blocks: DataFrame, separated: DataFrame, stride: int, every: int = 100) -> DataFrame:
    """(path, ratio, cos, verdict) of each track: ``signal.gate`` on blocks."""

    @F.pandas_udf("n long, xx double, ss double, ab double, aa double, bb double")
    def sums(x: pd.Series, parts: pd.Series, first: pd.Series) -> pd.DataFrame:
        rows = []
        for a, p, at in zip(x, parts, first):
            a, b = np.asarray(a, float), np.sum([np.asarray(v, float) for v in p], axis=0)
            k = slice(int(-at) % every, None, every)
            rows.append((len(a), a @ a, b @ b, a[k] @ b[k], a[k] @ a[k], b[k] @ b[k]))
        return pd.DataFrame(rows, columns=["n", "xx", "ss", "ab", "aa", "bb"])

    keys = ["path", "channel", "block"]
    sizes = blocks.where("channel = 0").groupBy("path").agg(F.sum(F.size("samples")).alias("length"))
    both = blocks.join(separated.groupBy(*keys).agg(F.collect_list("samples").alias("parts")), keys).join(sizes, "path")
    first = F.col("channel") * F.col("length") + F.col("block") * stride
    t = both.select("path", sums("samples", "parts", first).alias("s")).groupBy("path").agg(*[F.sum(f"s.{c}").alias(c) for c in ("n", "xx", "ss", "ab", "aa", "bb")])
    rms, silent = F.sqrt(F.col("xx") / F.col("n")), F.sqrt(F.col("xx") / F.col("n")) < 1e-5
    ratio = F.when(~silent, F.sqrt(F.col("ss") / F.col("n")) / rms)
    cos = F.when(~silent, F.col("ab") / (F.sqrt("aa") * F.sqrt("bb") + F.lit(1e-12)))
    fails = F.isnan(cos) | (cos < 0.95) | (ratio < 0.55) | (ratio > 1.8)
    return t.select("path", ratio.alias("ratio"), cos.alias("cos"), F.when(silent, "silent").when(fails, "failed").otherwise("passed").alias("verdict"))


def written(blocks: DataFrame, separated: DataFrame, outputs: DataFrame) -> DataFrame:
    """Writes each track's five stereo streams side by side; returns (path, output, frames).

    A task writes a file block by block under another name and renames it at the
    end, so a file is whole or absent.
    """
    master = blocks.select("path", "sample_rate", "channel", "block", F.lit(-1).alias("slot"), F.transform("samples", lambda v: v.cast("double")).alias("samples"))
    rows = master.unionByName(separated).join(outputs, "path")
    per_block = rows.groupBy("path", "output", "sample_rate", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "channel", "samples"))).alias("streams"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, temp, frames, done = None, None, "", 0, []

        def close() -> None:
            if out is not None:
                out.close()
                _add_metadata(temp)
                os.replace(temp, pcm_path(now[1]))
                done.append((*now, frames))

        for batch in batches:
            for path, output, rate, streams in zip(batch["path"], batch["output"], batch["sample_rate"], batch["streams"]):
                if now is None or path != now[0]:
                    close()
                    now, frames = (path, output), 0
                    os.makedirs(os.path.dirname(output), exist_ok=True)
                    temp = f"{pcm_path(output)}.{os.getpid()}.tmp"
                    out = wave.open(temp, "wb")
                    out.setnchannels(len(streams))
                    out.setsampwidth(2)
                    out.setframerate(int(rate))
                x = np.stack([np.asarray(s["samples"], float) for s in streams], 1)
                x = np.clip(np.nan_to_num(x), -0.99, 0.99)
                out.writeframes((x * 32767).astype("<i2").tobytes())
                frames += len(x)
        close()
        yield pd.DataFrame(done, columns=["path", "output", "frames"])

    ordered = per_block.repartition("path").sortWithinPartitions("path", "block")
    return ordered.mapInPandas(write, "path string, output string, frames long")


def aligned(blocks: DataFrame, lead: int, stride: int) -> DataFrame:
    """Blocks without the first ``lead`` samples of each track's channel and slot, numbered from 0 again."""
    skip, rest = divmod(lead, stride)
    over = Window.partitionBy("path", "channel", "slot").orderBy("block")
    nothing = F.array().cast("array<double>")
    joined = F.concat(F.slice("samples", rest + 1, stride), F.slice(F.coalesce(F.lead("samples").over(over), nothing), 1, rest))
    out = blocks.withColumn("samples", joined).withColumn("block", F.col("block") - skip)
    return out.where((F.col("block") >= 0) & (F.size("samples") > 0))


def separated(spark: SparkSession, wavs: DataFrame, s: Settings, length: int, stride: int) -> DataFrame:
    """path, sample_rate, channel, block, slot, samples: the parts, as the mean over ``s.shifts`` places of the chunks' grid.

    The places are spread evenly over half a second, so a run gives the same again.
    """
    batch = s.batch_size or PROFILES[s.profile]

    def at(lead: int) -> DataFrame:
        blocks = wav.decoded(wavs, stride, s.sample_rate, lead).where("error is null").drop("error")
        parts = separate.separate(chunked(blocks, length, stride), s.model, length, batch)
        return aligned(reassembled(parts, length, stride), lead, stride)

    if not s.shifts:
        return at(0)
    most = s.sample_rate // 2
    moved = reduce(DataFrame.unionByName, [at(most - most * k // s.shifts) for k in range(s.shifts)])

    @F.pandas_udf("array<double>")
    def mean(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: np.mean([np.asarray(x, float) for x in v], axis=0))

    keys = ["path", "sample_rate", "channel", "block", "slot"]
    return moved.groupBy(*keys).agg(F.collect_list("samples").alias("all")).select(*keys, mean("all").alias("samples"))


def process(spark: SparkSession, s: Settings) -> DataFrame:
    """Runs the plan. One row per track: path, output, status (done, skipped, planned, error), message.

    Errors stay with their track. What a step decides is written to the shared
    folder before the next one acts on it, so a lost executor changes no answer.
    States are recorded per result, so a run that breaks off starts again where it
    stopped.
    """
    s = s.located(spark).check()
    plan = scratch.written(planned(spark, s).select("path", "size", "mtime_ns", "title", "output", "error"), "plan")
    known = scratch.written(plan.where("error is null").select("output").distinct().select("output", ready(F.col("output")).alias("ready")), "ready")
    again = s.force or s.reprocess_existing
    todo = jobs.pending(plan.where("error is null"), known.where("ready"), "output", again)
    skipped = jobs.skipped(plan.where("error is null"), known.where("ready"), "output", again)
    kind = ["path", "output", "status", "message"]
    out = plan.where("error is not null").select("path", "output", F.lit("error").alias("status"), F.col("error").alias("message"))
    out = out.unionByName(skipped.select("path", "output", F.lit("skipped").alias("status"), F.lit("output exists").alias("message")))
    if s.dry_run:
        text_plan = mp4.plan_json(F.col("output"), F.col("path"), s.codec, s.bitrate, s.sample_rate, s.model)
        return out.unionByName(todo.select("path", "output", F.lit("planned").alias("status"), text_plan.alias("message")))
    length = int(s.segment * s.sample_rate)
    stride = signal.stride_of(length, s.overlap)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # few files at a time in a task
    wavs = files.contents(spark, s.music_dir).join(todo.select("path"), "path", "left_semi")
    read = scratch.written(wav.decoded(wavs, stride, s.sample_rate), "blocks")
    failed = read.where("error is not null").select("path", F.col("error").alias("why"))
    blocks = read.where("error is null").drop("error")
    parts = scratch.written(separated(spark, wavs.join(failed, "path", "left_anti"), s, length, stride), "parts")
    verdicts = scratch.written(checked(blocks, parts, stride), "verdicts")
    good = todo.join(verdicts.where("verdict <> 'failed'"), "path", "left_semi").select("path", "output")
    files_written = scratch.written(written(blocks.join(good, "path", "left_semi"), parts.join(good, "path", "left_semi"), good), "outputs")
    note = F.format_string("corr=%.3f, rms_ratio=%.3f", "cos", "ratio")
    result = (
        todo.select("path", "output")
        .join(verdicts, "path", "left")
        .join(files_written.select("path", "frames"), "path", "left")
        .join(failed, "path", "left")
        .select(
            "path",
            "output",
            F.when(F.col("frames").isNotNull(), "done").otherwise("error").alias("status"),
            F.when(F.col("verdict") == "silent", "silent master")
            .when(F.col("verdict").isNull(), F.coalesce("why", F.lit("cannot decode: only PCM WAV is read here")))
            .otherwise(note)
            .alias("message"),
        )
    )
    out = scratch.written(out.unionByName(result).select(*kind), "results")
    if s.state_dir:
        log = jobs.JobLog(spark, s.state_dir)
        now = plan.select("path", "size", "mtime_ns").join(out, "path")
        status = F.when(F.col("status").isin("done", "skipped"), "done").otherwise("error")
        log.append(now.select("path", "size", "mtime_ns", status.alias("status"), F.col("output").alias("output_path"), F.when(status == "error", F.col("message")).alias("error"), F.lit(time.time()).alias("updated_at")))
    if s.collection and s.update_collection:
        mark(s.collection, [r[0] for r in out.where("status in ('done', 'skipped')").select("path").toLocalIterator()])
    return out


def mark(path: str, done: list[str]) -> int:
    """Sets the generated bit of finished tracks in the collection file, after a backup."""
    file = collection.CollectionFile(path)
    changed, missing = file.mark(done)
    if changed:
        file.backup()
        file.write()
    if missing:
        raise CollectionError(f"{len(missing)} finished tracks are not in the collection, the first: {missing[0]}")
    return changed
