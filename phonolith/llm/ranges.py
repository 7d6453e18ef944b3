"""Ranges of document ids of about equal rows, from one scan of the ids alone.

The bounds are quantiles of the ids. Where an id makes several bounds (it holds
more rows than a range should), its rows are dealt to the ranges between by a
hash of their text; rows without an id fill ranges of their own, dealt likewise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Ranges:
    bounds: list[int]
    #: Ranges of rows without an id: before the others or after them.
    nameless: int
    nulls_first: bool

    @classmethod
    def of(cls, rows: DataFrame, parts: int, nulls_first: bool = False) -> Ranges:
        """At most ``parts`` ranges of the ids in ``rows`` (doc_id) and some for null ids."""
        ids = rows.agg(
            F.count("doc_id").alias("named"),
            F.count(F.lit(1)).alias("all"),
            F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [1.0], max(10_000, 20 * parts)).alias("bounds"),
        ).first()
        nameless = -(-parts * (ids["all"] - ids["named"]) // max(1, ids["all"]))
        return cls((ids["bounds"] or [])[: parts - 1], nameless, nulls_first)

    @property
    def count(self) -> int:
        return len(self.bounds) + 1 + self.nameless

    @property
    def whole(self) -> bool:
        """Whether every id lies in one range, whose greatest id is its bound, and no id is null."""
        return not self.nameless and len(set(self.bounds)) == len(self.bounds)

    def _below(self, compare) -> Column:
        """How many bounds stand so to doc_id: counted among each step-th, then in the step that is left."""
        step = max(1, math.isqrt(len(self.bounds)))
        every, coarse = (F.lit(b).cast("array<long>") for b in (self.bounds, self.bounds[step - 1 :: step]))
        steps = F.size(F.filter(coarse, lambda b: compare(b, F.col("doc_id")))) * F.lit(step)
        return steps + F.size(F.filter(F.slice(every, steps + 1, F.lit(step)), lambda b: compare(b, F.col("doc_id"))))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, text) with ``part``, from 0, ascending with doc_id."""
        salt = F.pmod(F.xxhash64("text"), F.lit(1 << 30)).cast("int")
        low = self._below(lambda b, i: b < i)
        if len(set(self.bounds)) < len(self.bounds):
            last = self._below(lambda b, i: b <= i)
            low = F.when(last - low > 1, low + salt % (last - low + 1)).otherwise(low)
        nulls = salt % F.lit(max(1, self.nameless)) + F.lit(0 if self.nulls_first else len(self.bounds) + 1)
        named = low + F.lit(self.nameless if self.nulls_first else 0)
        return rows.withColumn("part", F.when(F.col("doc_id").isNull(), nulls).otherwise(named).cast("int"))

    def greatest(self) -> Column:
        """Holds for the greatest id of each range but the last, where ``whole``."""
        return F.col("doc_id").isin(self.bounds)
