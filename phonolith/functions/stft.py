"""Short-time Fourier transform and its inverse on array columns (WN3, WN4, SC15 to SC18).

Spark has no FFT, so frames go through numpy in Arrow batches. One row is one
signal block; real and imaginary parts are two arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)


def reflect(x: np.ndarray, left: int, right: int) -> np.ndarray:
    return np.pad(x, (left, right), mode="reflect")


def spectrum(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """(frames, n_fft / 2) complex: the top bin and two frames at each side are left out."""
    count, side = -(-len(x) // hop), hop // 2 * 3
    padded = reflect(reflect(x, side, side + count * hop - len(x)), n_fft // 2, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][: count + 4]
    return (np.fft.rfft(frames * hann(n_fft), axis=1) / math.sqrt(n_fft))[2 : 2 + count, :-1]


def signal(z: np.ndarray, n_fft: int, hop: int, length: int) -> np.ndarray:
    """The inverse. Exact for inner samples without the top bin; outer frames are missing at the edges."""
    full = np.pad(z, ((2, 2), (0, 1)))
    frames = np.fft.irfft(full, n=n_fft, axis=1) * math.sqrt(n_fft) * hann(n_fft)
    # Each frame is cut into steps of one hop; the steps that meet are summed over all frames at once.
    steps = -(-n_fft // hop)
    frames = np.pad(frames, ((0, 0), (0, steps * hop - n_fft))).reshape(len(full), steps, hop)
    square = np.pad(hann(n_fft) ** 2, (0, steps * hop - n_fft)).reshape(steps, hop)
    out, norm = np.zeros((len(full) + steps, hop)), np.zeros((len(full) + steps, hop))
    for step in range(steps):
        out[step : step + len(full)] += frames[:, step]
        norm[step : step + len(full)] += square[step]
    out, norm = out.reshape(-1), norm.reshape(-1)
    start = n_fft // 2 + hop // 2 * 3
    return (out / np.maximum(norm, 1e-8))[start : start + length]


def stft(x: Column, n_fft: int, hop: int) -> Column:
    """array<struct<re: array, im: array>>, one element per frame."""

    @F.pandas_udf("array<struct<re:array<double>,im:array<double>>>")
    def run(signals: pd.Series) -> pd.Series:
        return signals.map(lambda x: None if x is None else [{"re": f.real.tolist(), "im": f.imag.tolist()} for f in spectrum(np.asarray(x, float), n_fft, hop)])

    return run(x)


def magnitude(z: Column) -> Column:
    """Absolute values of a frame's bins."""
    return F.zip_with(z["re"], z["im"], lambda re, im: F.hypot(re, im))


def as_channels(channels: Column) -> Column:
    """An array of complex channels (struct re, im) as twice as many real ones: each one's real, then its imaginary part."""
    return F.flatten(F.transform(channels, lambda z: F.array(z["re"], z["im"])))


def from_channels(real: Column) -> Column:
    """``as_channels`` undone."""
    at = F.sequence(F.lit(0), F.floor(F.size(real) / 2).cast("int") - 1)
    return F.transform(at, lambda i: F.struct(F.get(real, 2 * i).alias("re"), F.get(real, 2 * i + 1).alias("im")))


def istft(frames: Column, n_fft: int, hop: int, length: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(spectra: pd.Series) -> pd.Series:
        z = spectra.map(lambda s: None if s is None else np.array([np.asarray(f["re"]) + 1j * np.asarray(f["im"]) for f in s]))
        return z.map(lambda v: None if v is None else signal(v, n_fft, hop, length).tolist())

    return run(frames)
