"""Separators as plug-ins over blocks of samples (MD1 to MD5, PRJ8, WN5).

No trained model ships here. ``linear-stand-in`` is a placeholder that splits a
signal by fixed shares which sum to one, so that plans, overlap-add and the gate
can be run; it separates nothing. A real model registers under its own name: a
function from (blocks, samples) to (blocks, slots, samples) that each Python
worker builds once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SeparationError

SLOTS = ("drums", "bass", "other", "vocals")
_SHARES = np.array([0.4, 0.3, 0.2, 0.1])
_BUILDERS: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {}


def register(name: str, build: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> None:
    _BUILDERS[name] = build


def known() -> list[str]:
    return sorted(_BUILDERS)


register("linear-stand-in", lambda: lambda x: x[:, None, :] * _SHARES[None, :, None])


def named(parts: DataFrame, names: tuple[str, ...] = SLOTS) -> DataFrame:
    """``slot`` as a name by its place; slots without a name go."""
    return parts.where(F.col("slot") < len(names)).withColumn("slot", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1))


def separate(chunks: DataFrame, model: str, length: int, batch: int = 16) -> DataFrame:
    """(keys, chunk, samples) to (keys, chunk, slot, samples).

    Chunks are padded to ``length`` and go to the model in batches of one size,
    the last one padded and cut again.
    """
    if model not in _BUILDERS:
        raise SeparationError(f"unknown separator {model}; known: {', '.join(sorted(_BUILDERS))}")
    build = _BUILDERS[model]
    keys = [f for f in chunks.schema.fields if f.name != "samples"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", slot int, samples array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = build()
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                x = np.zeros((batch, length))
                for i, s in enumerate(part["samples"]):
                    x[i, : len(s)] = s
                y = apply(x)[: len(part)]
                out = part.drop(columns="samples").loc[part.index.repeat(y.shape[1])].reset_index(drop=True)
                out["slot"] = np.tile(np.arange(y.shape[1], dtype=np.int32), len(part))
                sizes = [len(s) for s in part["samples"]]
                out["samples"] = [y[i, k, : sizes[i]].tolist() for i in range(len(part)) for k in range(y.shape[1])]
                yield out

    return chunks.mapInPandas(run, kind)
