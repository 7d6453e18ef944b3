"""Operator 6, mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until the shares
of every source, language and topic meet their targets. No cell can give more
than it holds: in each step a weight is cut at what makes its documents certain,
and the next steps make up for it, so that the sample itself has the target
shares. A document is drawn when its hash lies below its cell's probability.

Targets default to the sums, over each source, language and topic, of the cells'
tempered shares (the share to the power ``temper``, then made to sum to 1), which
lifts small groups and lowers large ones. Margins that come from one table fit
each other, also where a topic occurs in one language only. A target, of a cell
here or of a value that the caller names, above what there is is cut to that, and
the others share the rest. ``Fit.gap`` is how far the shares are from the targets at
the end; beyond ``close`` there is a warning, or an error if ``strict``.

Topics are clusters of the documents' TF-IDF vectors: words are hashed to
``TERMS`` terms, and each document's counts of them are written, so that texts are
split once; the document frequencies are counted over all documents; each
document's weighted terms are projected on ``DIMS`` random signs; spherical
k-means runs over all documents, its sums grouped by cluster. Documents without
words have no topic. Tokens are stretches without white space, or the column
that ``tokens_col`` names.

Cells are counted with map-side sums. Up to ``driver_cells`` cells, a checked
number, are raked as arrays; beyond it the same steps, rounds and limits run as
DataFrame aggregations through the shared folder.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, pieces_of, small_batches, working_tables, written

DRIVER_CELLS = 100_000
MARGINS = ("source", "lang", "topic")
TERMS, DIMS, TOPICS, TOPIC_ROUNDS = 1 << 15, 64, 8, 5
ROUNDS, CLOSE = 1000, 1e-6
_NONE = "\0none"
_MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_`"


class Terms:
    """The numbers of words' terms: hashes of the lower-cased words without marks at their ends; 0 for marks alone."""

    def __init__(self, most: int = 100_000):
        self.most, self.known = most, {}

    def of(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    w = words[i]
                    bare = w.strip(_MARKS).lower()
                    out[i] = known[w] = 1 + xxhash.xxh32_intdigest(bare.encode("utf-8", "replace")) % (TERMS - 1) if bare else 0
        return out


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's end."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind), np.cumsum([len(d) for d in data]) // np.dtype(kind).itemsize


def _frequencies(counted: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows there are, and how many have each term: at most ``TERMS`` rows come back. ``counted``: __terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TERMS, np.int64)
        for b in batches:
            sums += np.bincount(_numbers(b.column(0), "<u2")[0], minlength=TERMS)  # a row has a term once
            sums[0] += b.num_rows  # in place of the marks
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["term", "n"])

    found = counted.select("__terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(out[0]), out


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(6).integers(0, 2, (TERMS, DIMS), np.int8) * 2 - 1


def vector(counts: Counter, idf: np.ndarray) -> np.ndarray:
    """Unit vector of a document's terms; zeros without any."""
    counts.pop(0, None)
    if not counts:
        return np.zeros(DIMS, np.float32)
    return _vector(np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts)), idf)


def _vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    if not len(terms):
        return np.zeros(DIMS, np.float32)
    weights = (1 + np.log(counts)) * idf[terms]
    v = weights @ _signs()[terms]
    return (v / max(1e-12, float(np.sqrt(v @ v)))).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, DIMS)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of the greatest cosine; -1 for zero vectors."""
    return np.where(x.any(1), (x @ centres.T).argmax(1), -1)


def topic_centres(vectors: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """Spherical k-means over all rows of ``vec``, from the different vectors of least hash."""
    some = vectors.where(F.exists("vec", lambda v: v != 0)).select("vec", F.xxhash64("vec").alias("h"))
    seeds = [r[0] for r in some.select("h").distinct().orderBy("h").limit(topics).collect()]  # at most ``topics``
    first = {r["h"]: r["vec"] for r in some.where(F.col("h").isin(seeds)).groupBy("h").agg(F.first("vec").alias("vec")).collect()}
    centres = np.array([first[h] for h in seeds], np.float32).reshape(-1, DIMS)
    if not len(centres):
        return np.zeros((1, DIMS), np.float32)
    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(now), DIMS))
            for b in batches:
                x = _matrix(b.column(0))
                at = _nearest(x, now)
                for k in range(len(now)):
                    total[k] += x[at == k].sum(0, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["at", "v"])

        got = some.select("vec").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # topics * DIMS rows
        total = np.zeros(centres.size)
        for r in got:
            total[r["at"]] = r["v"]
        total = total.reshape(centres.shape)
        length = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(length > 0, total / np.maximum(length, 1e-12), centres).astype(np.float32)
    return centres


def facts(docs: DataFrame, id_col: str, text_col: str, seed: int, tokens_col: str | None, topics: int, carry: list[str]) -> DataFrame:
    """__source, __lang, __topic, __tokens and __draw of each row, beside the columns ``carry``; all but the topic written."""
    small_batches(docs.sparkSession)
    names = {c: f"__c{i}" for i, c in enumerate(carry)}  # no name clashes with those used here
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc_id = F.col(f"`{id_col}`").cast("long")
    # A row without an id is drawn by its text.
    draw = F.when(doc_id.isNotNull(), F.xxhash64(doc_id, F.lit(seed))).otherwise(F.xxhash64(text, F.lit(seed)))
    given = F.lit(None) if tokens_col is None else F.col(f"`{tokens_col}`")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        F.coalesce("source", F.lit(_NONE)).alias("__source"),
        F.coalesce("lang", F.lit(_NONE)).alias("__lang"),
        given.cast("long").alias("__given"),
        draw.alias("__draw"),
        text.alias("__text"),
    )
    kept = [f for f in rows.schema.fields if f.name not in ("__given", "__text")]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in pieces_of(batches):
            words = [t.split() for t in b.column("__text").to_pylist()]
            counts = [Counter(terms.of(w)) for w in words]
            for c in counts:
                c.pop(0, None)
            found = [np.fromiter(c.keys(), "<u2", len(c)).tobytes() for c in counts]
            often = [np.fromiter(c.values(), "<u4", len(c)).tobytes() for c in counts]
            tokens = [len(w) if g is None else g for w, g in zip(words, b.column("__given").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in kept], pa.array(found, pa.binary()), pa.array(often, pa.binary()), pa.array(tokens, pa.int64())],
                names=[*[f.name for f in kept], "__terms", "__counts", "__tokens"],
            )

    with working_tables():
        counted = written(rows.mapInArrow(count, f"{kind}, __terms binary, __counts binary, __tokens long"), "mixing-counts")
        n, frequency = _frequencies(counted)
        idf = docs.sparkSession.sparkContext.broadcast(np.log((1 + n) / (1 + frequency)))  # TERMS numbers

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces_of(batches):
                (terms, ends), (counts, _) = _numbers(b.column("__terms"), "<u2"), _numbers(b.column("__counts"), "<u4")
                own = zip(np.split(terms.astype(np.int64), ends[:-1]), np.split(counts.astype(float), ends[:-1]))
                vectors = np.array([_vector(t, c, idf.value) for t, c in own], np.float32).reshape(-1)
                offsets = pa.array(np.arange(0, len(vectors) + 1, DIMS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(f.name) for f in kept], pa.ListArray.from_arrays(offsets, pa.array(vectors)), b.column("__tokens")],
                    names=[*[f.name for f in kept], "vec", "__tokens"],
                )

        measured = keep(counted.mapInArrow(measure, f"{kind}, vec array<float>, __tokens long"), "mixing-vectors")
    centres = docs.sparkSession.sparkContext.broadcast(topic_centres(measured.select("vec"), topics))

    @F.pandas_udf("string")
    def topic(vectors: pd.Series) -> pd.Series:
        at = _nearest(np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, DIMS), np.float32), centres.value)
        return pd.Series([str(k) if k >= 0 else _NONE for k in at], dtype=object)

    return measured.withColumn("__topic", topic.asNondeterministic()("vec")).drop("vec")


def _targets(tokens: pd.Series, given: dict | None, temper: float, room: float) -> pd.Series:
    """Target share of each value of a margin (or each cell): the given ones, else tempered; none above its tokens over ``room``."""
    base = tokens.astype(float).where(tokens > 0, 0.0).pow(temper).where(tokens > 0, 0.0)
    if given is not None:
        base = pd.Series({k: float(given.get(None if k == _NONE else k, 0.0)) for k in tokens.index}, dtype=float).where(tokens > 0, 0.0)
    if not base.sum() or not room:
        return base * 0.0
    most, over = tokens / room, pd.Series(False, index=tokens.index)
    while True:
        left, free = max(0.0, 1 - most[over].sum()), base[~over].sum()
        goal = most.where(over, base / (free or 1.0) * left)
        more = over | (goal > most)
        if (more == over).all() or more.all():
            return goal
        over = more


@dataclass
class Fit:
    """Weights of the cells that meet the targets up to ``gap``."""

    cells: DataFrame | pd.DataFrame
    gap: float


def rake(cells: pd.DataFrame, targets: dict[str, pd.Series], most: np.ndarray | None = None, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Fitted weight of each cell, none above ``most``, and the greatest distance of a margin from its target."""
    w = cells["tokens"].to_numpy(float)
    w = w / w.sum() if w.sum() else w
    most = np.full(len(w), np.inf) if most is None else most
    codes = {}
    for m in MARGINS:
        kind = cells[m].astype("category").cat
        codes[m] = kind.codes.to_numpy(), targets[m].reindex(kind.categories).to_numpy(float)
    gap = 0.0
    for _ in range(rounds):
        gap = 0.0
        for at, goal in codes.values():
            now = np.bincount(at, w, minlength=len(goal))
            gap = max(gap, float(np.abs(now - goal).max()) if len(goal) else 0.0)
            w = np.minimum(most, w * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at])
        if gap < close:
            break
    return w, gap


def _rake_distributed(cells: DataFrame, targets: dict[str, DataFrame], room: float, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """``rake`` for any number of cells: (source, lang, topic, tokens, w)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    gap = 0.0
    for _ in range(rounds):
        gap = 0.0
        for m in MARGINS:
            factor = now.groupBy(m).agg(F.sum("w").alias("__now")).join(targets[m], m).withColumn("__factor", F.when(F.col("__now") > 0, F.col("goal") / F.col("__now")).otherwise(0.0))
            factor = written(factor, "mixing-factor")
            gap = max(gap, factor.agg(F.max(F.abs(F.col("goal") - F.col("__now")))).first()[0] or 0.0)
            raised = F.least(F.col("w") * F.col("__factor"), F.col("tokens") / F.lit(float(room or 1)))
            now = now.join(factor.select(m, "__factor"), m).withColumn("w", raised).drop("__factor")
        now = written(now, "mixing-cells")
        if gap < close:
            break
    return now.select(*MARGINS, "tokens", "w"), gap


def fit(cells: DataFrame, targets: dict[str, dict], keep: float, temper: float, driver_cells: int, rounds: int = ROUNDS, close: float = CLOSE) -> Fit:
    """``w`` of each cell (source, lang, topic, tokens): its share of the sample's tokens, which are ``keep`` of all usable.

    Usable are the tokens of cells whose three targets are above 0.
    """
    spark = cells.sparkSession
    excluded = F.lit(False)
    for m in MARGINS:
        if targets.get(m) is not None:
            named = [k for k, v in targets[m].items() if v > 0 and k is not None]
            excluded = excluded | ~F.when(F.col(m) == _NONE, F.lit((targets[m].get(None) or 0) > 0)).otherwise(F.col(m).isin(named))
    cells = cells.withColumn("tokens", F.when(excluded, 0).otherwise(F.col("tokens")))
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    room = keep * float(total or 0)
    # A margin's values come to the driver where they are as few as cells may be; else the tempered targets stay a table.
    if n <= driver_cells:
        local = cells.toPandas()
        own = _targets(local["tokens"], None, temper, room)
        goals = {m: own.groupby(local[m]).sum() if targets.get(m) is None else _targets(local.groupby(m)["tokens"].sum(), targets[m], temper, room) for m in MARGINS}
        local["w"], gap = rake(local, goals, local["tokens"].to_numpy(float) / (room or 1), rounds, close) if len(local) else ([], 0.0)
        return Fit(spark.createDataFrame(local, "source string, lang string, topic string, tokens long, w double"), gap)
    t = F.col("tokens").cast("double")
    tempered = cells.select(*MARGINS, t.alias("t"), F.when(t > 0, F.pow(t, F.lit(temper))).otherwise(0.0).alias("base"))
    own = written(_cut_targets(tempered, [*MARGINS], room), "mixing-own")
    frames = {}
    for m in MARGINS:
        goal = own.groupBy(m).agg(F.sum("goal").alias("goal"))
        if targets.get(m) is not None:
            given = spark.createDataFrame([(_NONE if k is None else k, float(v)) for k, v in targets[m].items()], f"{m} string, given double")
            sums = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t")).join(given, m, "left")
            base = F.when(F.col("t") > 0, F.coalesce("given", F.lit(0.0))).otherwise(0.0)
            goal = _cut_targets(sums.select(m, "t", base.alias("base")), [m], room)
        frames[m] = written(goal, "mixing-goals")
    found, gap = _rake_distributed(cells, frames, room, rounds, close)
    return Fit(found, gap)


def _cut_targets(sums: DataFrame, keys: list[str], room: float) -> DataFrame:
    """``_targets`` for any number of values: (keys, goal)."""
    most = F.col("t") / F.lit(float(room or 1))
    now = sums.withColumn("over", F.lit(False))
    while True:
        held, free = now.agg(F.sum(F.when(F.col("over"), most)), F.sum(F.when(~F.col("over"), F.col("base")))).first()
        left, free = 1 - (held or 0.0), free or 0.0
        goal = F.when(F.col("over"), most).otherwise(F.col("base") / F.lit(free or 1.0) * F.lit(max(0.0, left)))
        new = written(now.withColumn("goal", goal).withColumn("next", F.col("over") | (F.col("goal") > most)), "mixing-over")
        grown, all_over = new.agg(F.max(F.col("next") & ~F.col("over")), F.min("next")).first()
        if not grown or all_over:
            return new.select(*keys, "goal")
        now = new.select(*keys, "t", "base", F.col("next").alias("over"))


def mix_rows(
    docs: DataFrame,
    targets: dict[str, dict] | None = None,
    keep: float = 0.5,
    temper: float = 0.5,
    seed: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens_col: str | None = None,
    topics: int = TOPICS,
    carry: list[str] | None = None,
    driver_cells: int = DRIVER_CELLS,
    rounds: int = ROUNDS,
    close: float = CLOSE,
    strict: bool = False,
) -> DataFrame:
    """The rows of ``docs`` (columns ``carry``, all by default) with __source, __lang, __topic, __tokens, __w, __p and __sampled."""
    carry = docs.columns if carry is None else carry
    rows = facts(docs, id_col, text_col, seed, tokens_col, topics, carry)
    named = [F.col(f"__{m}").alias(m) for m in MARGINS]
    cells = written(rows.groupBy(*named).agg(F.sum("__tokens").alias("tokens")), "mixing-cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    found = fit(cells, targets or {}, keep, temper, driver_cells, rounds, close)
    if total and found.gap > max(close, 1e-4):
        said = f"the margins miss their targets by up to {found.gap:.2g}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    fitted = written(found.cells, "mixing-fitted")
    usable = fitted.agg(F.sum("tokens")).first()[0] or 0
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") * F.lit(keep * float(usable)) / F.col("tokens"))).otherwise(F.lit(0.0))
    held = cells.select(*MARGINS, (F.col("tokens") == 0).alias("empty"))
    fitted = written(fitted.join(held, [*MARGINS]).select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("w").alias("__w"), F.when(F.col("empty"), 1.0).otherwise(p).alias("__p")), "mixing-rates")
    few = fitted.count() <= driver_cells
    out = rows.join(F.broadcast(fitted) if few else fitted, [f"__{m}" for m in MARGINS])
    # The hash's upper 53 bits as a number from 0 to 1.
    draw = F.shiftrightunsigned("__draw", 11).cast("double") / F.lit(float(2**53))
    back = lambda c: F.when(F.col(c) != _NONE, F.col(c)).alias(c)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], *[back(f"__{m}") for m in MARGINS], "__tokens", "__w", "__p", (draw < F.col("__p")).alias("__sampled"))


def mix(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, weight, probability, sampled.

    ``targets`` maps source, lang or topic to {value: share}; values not named
    get nothing. Null source, language or topic is a value of its own (key None).
    Null text has no tokens, and such a document the probability of its cell, 1 in
    a cell without tokens. Very long texts are read whole. Repeated rows share
    their draw; a row with a null id is drawn by its text. An empty table gives no
    rows. Other columns are ignored, whatever their names. Further settings are
    those of ``mix_rows``.
    """
    found = mix_rows(docs, id_col=id_col, carry=[id_col], **settings)
    return found.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        *[F.col(f"__{m}").alias(m) for m in MARGINS],
        F.col("__tokens").alias("n_tokens"),
        F.col("__w").alias("weight"),
        F.col("__p").alias("probability"),
        F.col("__sampled").alias("sampled"),
    )


def sample(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are drawn, with its columns: rows without an id and repeated ones too."""
    return mix_rows(docs, **settings).where("__sampled").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Sampling of ``documents`` towards tempered shares of source, language and topic."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
