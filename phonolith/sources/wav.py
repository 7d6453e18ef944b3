"""PCM WAV: header and samples of files, a writer, and a sine (SRC8 to SRC10, SNK1's stand-in).

Other encodings need an external decoder, which this package does not have; a
file in one of them is an error of its own, not of the run.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INFO = "channels int, sample_width int, sample_rate int, frames bigint"
_BLOCK = "path string, sample_rate int, channel int, block bigint, samples array<float>"


def sine(spark: SparkSession, frequency: float, seconds: float, sample_rate: int = 44100, amplitude: float = 0.15) -> DataFrame:
    """(t, sample): 16-bit samples, cut towards zero."""
    phase = F.lit(2.0) * F.pi() * F.lit(frequency) * F.col("id") / F.lit(sample_rate)
    return spark.range(int(seconds * sample_rate)).select(F.col("id").alias("t"), (F.lit(amplitude) * 32767 * F.sin(phase)).cast("int").alias("sample"))


def encode(samples: np.ndarray, sample_rate: int) -> bytes:
    """16-bit PCM of (frames, channels) samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(sample_rate)
        w.writeframes(np.ascontiguousarray(samples, "<i2").tobytes())
    return out.getvalue()


def info(content: Column) -> Column:
    """Struct of the header; null fields for what is no WAV."""

    @F.pandas_udf(_INFO)
    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                with wave.open(io.BytesIO(bytes(data)), "rb") as w:
                    rows.append((w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()))
            except (wave.Error, EOFError, TypeError):
                rows.append((None,) * 4)
        return pd.DataFrame(rows, columns=["channels", "sample_width", "sample_rate", "frames"]).astype("Int64")

    return run(content)


def _floats(raw: bytes, width: int, channels: int) -> np.ndarray:
    """(frames, channels) between -1 and 1 of PCM of 8, 16, 24 or 32 bits."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 2**15
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2**31).astype(np.float32)
    else:
        x = (np.frombuffer(raw, "<i4") / 2**31).astype(np.float32)
    return x.reshape(-1, channels)


def _stereo(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Mono counts twice; of more than two channels the first two stay."""
    for x in parts:
        yield np.repeat(x, 2, 1) if x.shape[1] == 1 else x[:, :2]


def _resampled(parts: Iterator[np.ndarray], rate: int, target: int) -> Iterator[np.ndarray]:
    """Linear interpolation at the new rate, with the last frame of a part kept for the next one."""
    done, before, held = 0, 0, np.zeros((0, 2), np.float32)
    for x in parts:
        held = np.concatenate([held, x])
        last = before + len(held) - 1  # the last frame known
        count = max(0, last * target // rate + 1 - done)
        at = (done + np.arange(count)) * rate / target - before
        low = np.minimum(at.astype(np.int64), len(held) - 1)
        high = np.minimum(low + 1, len(held) - 1)
        share = (at - low)[:, None].astype(np.float32)
        yield held[low] * (1 - share) + held[high] * share
        done += count
        drop = max(0, min(len(held) - 1, done * rate // target - before))
        held, before = held[drop:], before + drop


def _blocked(parts: Iterator[np.ndarray], size: int, lead: int) -> Iterator[np.ndarray]:
    """Parts of ``size`` frames, the last one shorter, after ``lead`` frames of silence."""
    held = np.zeros((lead, 2), np.float32)
    for x in parts:
        held = np.concatenate([held, x])
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if len(held):
        yield held


def decoded(files: DataFrame, size: int = 1 << 16, rate: int | None = None, lead: int = 0) -> DataFrame:
    """Samples of PCM WAV files (path, content) in stereo blocks of ``size``, between -1 and 1, at ``rate`` if given.

    A file that cannot be read, or has no frames, gives one row with ``error``
    and no samples; the others are not touched by it.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sample_rate", "channel", "block", "samples", "error"]
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                number = 0
                try:
                    with wave.open(io.BytesIO(bytes(data)), "rb") as w:
                        own, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
                        raw = iter(lambda: w.readframes(size), b"")
                        parts = _stereo(_floats(r, width, channels) for r in raw)
                        if rate is not None and rate != own:
                            parts = _resampled(parts, own, rate)
                        for x in _blocked(parts, size, lead):
                            yield pd.DataFrame([(path, rate or own, c, number, np.ascontiguousarray(x[:, c]), None) for c in range(2)], columns=names)
                            number += 1
                        error = None if w.getnframes() else "no frames"
                except (wave.Error, EOFError, ValueError, TypeError) as e:
                    error = f"cannot decode: {e or 'the file ends early'}"
                if error:
                    yield pd.DataFrame([(path, rate or 0, 0, -1, None, error)], columns=names)

    return files.select("path", "content").mapInPandas(read, f"{_BLOCK}, error string")


def blocks(files: DataFrame, size: int = 1 << 16, rate: int | None = None) -> DataFrame:
    """The samples of ``decoded`` alone."""
    return decoded(files, size, rate).where("error is null").drop("error")
