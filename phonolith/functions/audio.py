"""Shapes of sampled signals as arrays of arrays: stereo form, stacking of slots, trimming (SC12, SC13, SC19).

Everything is array functions of the engine. An outer array of frames holds
channels; one of channels holds frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A signal with so few rows, fewer than columns, stands channel by channel.
MOST_CHANNELS = 8


def clipped(x: Column) -> Column:
    """Missing and NaN samples are 0; the rest stays within 0.99."""
    return F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def transposed(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(x[0]) - 1), lambda i: F.transform(x, lambda row: F.get(row, i)))


def stereo(x: Column) -> Column:
    """Frames of two clipped channels: one channel counts twice, of more the first two stay. Null for empty or ragged input."""
    rows, columns = F.size(x), F.size(F.get(x, F.lit(0)))
    planar = (rows <= MOST_CHANNELS) & (columns > rows)
    # Named once by an outer transform, so that the transposition is not written out twice.
    frames = F.when(planar, transposed(x)).otherwise(x)
    pair = lambda f: F.array(clipped(f[0]), clipped(F.when(F.size(f) == 1, f[0]).otherwise(F.get(f, F.lit(1)))))
    even = F.forall(x, lambda row: F.size(row) == columns)
    return F.when((rows > 0) & (columns > 0) & even, F.transform(frames, pair))


def stacked(signals: list[Column]) -> Column:
    """One array of signals of frames, all as long as the longest, filled up with silence; null if one is missing."""
    longest = F.greatest(*[F.size(s) for s in signals])
    silence = F.array(F.lit(0.0), F.lit(0.0))
    filled = [F.concat(s, F.array_repeat(silence, longest - F.size(s))) for s in signals]
    there = reduce(lambda a, b: a & b, [s.isNotNull() for s in signals])
    return F.when(there, F.array(*filled))


def centred(x: Column, length: Column) -> Column:
    """The middle ``length`` samples; an odd one too many goes at the end. Null if there are too few."""
    more = F.size(x) - length
    return F.when(more >= 0, F.slice(x, (F.floor(more / 2) + 1).cast("int"), length))
