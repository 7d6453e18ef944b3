"""Operator 9, quality classifier by co-training two views.

The text view sees shape statistics of the text and which words it has, hashed
to ``BUCKETS`` and raised by how far apart their rates in the two classes are;
the metadata view sees source, language and length. Features of
whole texts of every document are written once for the training and go
afterwards; labelled ones are passed over by a bit for each row, and the scoring
reads the texts again. Starting from the
labels, in each round each view scores all unlabelled documents and hands the
``most`` it is surest of, for each class, to the other as pseudo-labels. At the
end the views' scores are calibrated together on labels held out of the
training, and the combined model scores every document.

One model predicts quality, a second toxicity; a document stays when its
quality is at least ``threshold`` and its toxicity below it.

The fit takes at most ``max_labelled`` labelled documents, those with the least
hashes of their ids, and ``most`` pseudo-labels for each class, view and round.
These bounds are parameters; no unlabelled document is left out of the search
for the surest, and no word out of the features.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_shuffles, pieces_of, small_batches, working_tables, written

_WORDS = re.compile(r"[^\W\d_]+")
META, BUCKETS = 64, 1 << 16
#: Labelled documents of the fit, pseudo-labels for each class, view and round, and how sure a view must be of one.
MAX_LABELLED, MOST, SURE = 6000, 150, 0.97
#: Class of each byte: 0 other, 1 upper case, 2 digit, 3 punctuation, 4 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
SHAPES = 12


def shape(text: str) -> list[float]:
    """Statistics of a text's form, each about between 0 and 2; zeros for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * SHAPES
    counts = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=5)
    visible = max(1, int(counts.sum() - counts[4]))
    lines = text.split("\n")
    return [
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        counts[1] / visible,
        counts[2] / visible,
        counts[3] / visible,
        sum(map(str.isupper, words)) / n,
        sum(w[-1] in "!*#$%&|~^=<>+" for w in words) / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        min(2.0, visible / n / 10),
        math.log1p(n) / 10,
        math.log1p(len(lines)) / 10,
    ]


class Buckets:
    """The sorted numbers of a text's different words."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def of(self, text: str) -> list[int]:
        words, known = set(_WORDS.findall(text.lower())), self.known
        if len(known) > self.most:
            known.clear()
        found = set(map(known.get, words))
        if None in found:
            found.remove(None)
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "replace")) % BUCKETS
                    found.add(known[w])
        return sorted(found)


def metadata(lang: str | None, source: str | None, n_chars: float | None) -> list[int]:
    """Indices of the metadata features that are on."""

    def at(kind: str, value) -> int:
        return xxhash.xxh32_intdigest(f"{kind}={value}".encode("utf-8", "replace")) % META

    size = int(math.log2(n_chars + 1)) if n_chars is not None and n_chars >= 0 else -1
    return [at("lang", lang), at("source", source), at("size", size)]


@dataclass
class Sparse:
    """Rows of feature indices with value 1, beside dense columns."""

    dense: np.ndarray
    index: np.ndarray
    rows: np.ndarray
    width: int

    @classmethod
    def of(cls, dense: np.ndarray, lists: list, width: int) -> Sparse:
        sizes = np.array([len(x) for x in lists], np.int64)
        index = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) and sizes.sum() else np.empty(0, np.int64)
        return cls(dense, index, np.repeat(np.arange(len(lists)), sizes), width)

    def take(self, keep: np.ndarray) -> Sparse:
        place = np.full(len(self.dense), -1)
        place[keep] = np.arange(len(keep))
        at = place[self.rows] >= 0
        return Sparse(self.dense[keep], self.index[at], place[self.rows[at]], self.width)

    def logits(self, w: np.ndarray) -> np.ndarray:
        d = self.dense.shape[1]
        z = self.dense @ w[:d] + w[-1]
        return z + np.bincount(self.rows, w[d + self.index], minlength=len(z))[: len(z)] if len(self.index) else z

    def gradient(self, r: np.ndarray) -> np.ndarray:
        g = np.bincount(self.index, r[self.rows], minlength=self.width) if len(self.index) else np.zeros(self.width)
        return np.concatenate([self.dense.T @ r, g, [r.sum()]])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, y: np.ndarray, w: np.ndarray | None = None, steps: int = 120, penalty: float = 1e-3, gain: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Adam over all rows; ``gain`` multiplies the features, and the weights that come back are without it."""
    n = x.dense.shape[1] + x.width + 1
    w = np.zeros(n) if w is None else w.copy()
    gain = np.ones(n) if gain is None else gain
    m, v = np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        g = gain * x.gradient(_sigmoid(x.logits(gain * w)) - y) / max(1, len(y)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def contrast(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Gain of each feature: how far its rates in the two classes are apart, as a log ratio; words of one or two rows have none."""
    ones, zeros = np.bincount(x.index, y[x.rows], minlength=x.width), np.bincount(x.index, 1 - y[x.rows], minlength=x.width)
    ratio = np.abs(np.log((ones + 0.5) / (y.sum() + 1)) - np.log((zeros + 0.5) / ((1 - y).sum() + 1)))
    return np.concatenate([np.ones(x.dense.shape[1]), np.where(ones + zeros > 2, ratio, 0.0), [1.0]])


@dataclass
class Row:
    """A document's features, and its label if known."""

    shape: np.ndarray
    words: np.ndarray
    meta: np.ndarray
    y: float = math.nan


@dataclass
class View:
    text: np.ndarray
    meta: np.ndarray
    mix: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))

    def scores(self, text: Sparse, meta: Sparse) -> np.ndarray:
        return _sigmoid(self.mix[0] * text.logits(self.text) + self.mix[1] * meta.logits(self.meta) + self.mix[2])


def sparse_of(rows: list[Row], mean: np.ndarray, scale: np.ndarray) -> tuple[Sparse, Sparse]:
    """Both views of some rows."""
    shapes = np.array([r.shape for r in rows], float).reshape(len(rows), len(mean))
    return Sparse.of((shapes - mean) / scale, [r.words for r in rows], BUCKETS), Sparse.of(np.zeros((len(rows), 0)), [r.meta for r in rows], META)


@dataclass
class Scorer:
    """What a task needs to score rows: each view's weights, none of the rows they were learnt from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray | None]

    def sure(self, text: Sparse, meta: Sparse) -> dict[str, np.ndarray]:
        """Each view's scores of unlabelled rows."""
        return {"text": _sigmoid(text.logits(self.weights["text"])), "meta": _sigmoid(meta.logits(self.weights["meta"]))}


class CoTraining:
    """Two views of one target that teach each other."""

    def __init__(self, known: list[Row], mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        several = len(known) >= 50
        self.held = known[::5] if several else known
        start = [r for i, r in enumerate(known) if i % 5] if several else known
        if len({r.y for r in start}) < 2:
            start = self.held = known
        #: The rows that each view learns from.
        self.own = {"text": list(start), "meta": list(start)}
        self.weights: dict[str, np.ndarray | None] = {"text": None, "meta": None}
        self.bare: dict[str, np.ndarray | None] = {"text": None, "meta": None}  # without the gain
        self.ready = len({r.y for r in start}) > 1

    def learn(self, steps: int) -> None:
        for at, name in enumerate(("text", "meta")):
            rows = self.own[name]
            x, y = sparse_of(rows, self.mean, self.scale)[at], np.array([r.y for r in rows])
            gain = contrast(x, y) if name == "text" else np.ones(x.width + 1)
            self.bare[name] = fit(x, y, self.bare[name], steps, gain=gain)
            self.weights[name] = gain * self.bare[name]

    def scorer(self) -> Scorer:
        return Scorer(self.mean, self.scale, dict(self.weights))

    def sure(self, text: Sparse, meta: Sparse) -> dict[str, np.ndarray]:
        return self.scorer().sure(text, meta)

    def teach(self, name: str, rows: list[Row]) -> None:
        """Pseudo-labels of view ``name`` for the other."""
        self.own["meta" if name == "text" else "text"] += rows

    def view(self) -> View:
        """Both views' weights and their joint calibration on the labels held out."""
        text, meta = sparse_of(self.held, self.mean, self.scale)
        z = np.stack([text.logits(self.weights["text"]), meta.logits(self.weights["meta"])], 1)
        scale = np.maximum(1.0, np.abs(z).max(0))
        mix = fit(Sparse.of(z / scale, [[]] * len(self.held), 0), np.array([r.y for r in self.held]), np.array([*scale, 0.0]), 600, 1e-6)
        return View(self.weights["text"], self.weights["meta"], np.array([mix[0] / scale[0], mix[1] / scale[1], mix[2]]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    quality: View | None
    toxic: View | None


_FEATURES = "shape array<float>, words array<int>, meta array<int>"


def _inputs(docs: DataFrame) -> list:
    return [F.coalesce("text", F.lit("")).alias("__text"), F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source"), F.col("n_chars").cast("double").alias("__n")]


def _measured(b: pa.RecordBatch, buckets: Buckets) -> list[pa.Array]:
    """shape, words and meta of each row."""
    texts, langs, sources, sizes = (b.column(c).to_pylist() for c in ("__text", "__lang", "__source", "__n"))
    return [
        pa.array([shape(t) for t in texts], pa.list_(pa.float32())),
        pa.array([buckets.of(t) for t in texts], pa.list_(pa.int32())),
        pa.array([metadata(*x) for x in zip(langs, sources, sizes)], pa.list_(pa.int32())),
    ]


def features(docs: DataFrame) -> DataFrame:
    """id, uid and the features of each row; written, so that each row keeps its uid."""
    small_batches(docs.sparkSession)
    clean_shuffles(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), *_inputs(docs))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("uid"), *_measured(b, buckets)], names=["id", "uid", "shape", "words", "meta"])

    return written(rows.mapInArrow(measure, f"id long, uid long, {_FEATURES}"), "quality-features", compression="zstd")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row numbers of a column of lists."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), sizes)


def _views(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> tuple[Sparse, Sparse]:
    n = batch.num_rows
    shapes = (_lists(batch.column("shape"))[0].reshape(n, SHAPES) - mean) / scale
    (words, in_row), (meta, of_row) = _lists(batch.column("words")), _lists(batch.column("meta"))
    return Sparse(shapes, words.astype(np.int64), in_row, BUCKETS), Sparse(np.zeros((n, 0)), meta.astype(np.int64), of_row, META)


def _row(r, y: float) -> Row:
    return Row(np.array(r["shape"], float), np.array(r["words"], np.int64), np.array(r["meta"], np.int64), y)


@dataclass
class Marks:
    """A set of row numbers as one bit each: 64 numbers' bits stand at the place of their number over 64."""

    place: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, uid: str = "uid") -> Marks:
        """A word of 64 bits for each 64 rows comes to the driver."""
        bit = F.expr(f"shiftleft(1L, cast({uid} & 63 as int))")
        found = rows.groupBy(F.shiftright(uid, 6).alias("place")).agg(F.bit_or(bit).alias("bits")).orderBy("place").toArrow()
        return cls(found["place"].to_numpy(), found["bits"].to_numpy().view(np.uint64))

    def has(self, uids: np.ndarray) -> np.ndarray:
        if not len(self.place):
            return np.zeros(len(uids), bool)
        at = np.minimum(np.searchsorted(self.place, uids >> 6), len(self.place) - 1)
        return (self.place[at] == uids >> 6) & (self.bits[at] >> (uids & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _surest(found: DataFrame, trainers: dict[str, CoTraining], most: int, sure: float, taken: set[int], labelled: Broadcast | None = None) -> DataFrame:
    """(list, p, uid, features): of each task the rows, but those marked ``labelled``, that a view is surest of, for each target, view and class.

    list: target / view / class, as text.
    """
    # A broadcast lies on the disk of the driver and twice on that of each executor.
    scorers = {target: trainer.scorer() for target, trainer in trainers.items()}
    sent = found.sparkSession.sparkContext.broadcast((scorers, np.array(sorted(taken), np.int64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gone = sent.value
        for b in batches:
            if labelled is not None:
                b = b.filter(pa.array(~labelled.value.has(b.column("uid").to_numpy())))
            free = ~np.isin(b.column("uid").to_numpy(), gone)
            for target, scorer in own.items():
                for view, p in scorer.sure(*_views(b, scorer.mean, scorer.scale)).items():
                    for side, score in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero((score >= sure) & free)
                        at = at[np.argsort(-score[at], kind="stable")[:most]]
                        if len(at):
                            part = b.take(pa.array(at))
                            names = [f"{target}/{view}/{side}"] * len(at)
                            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(score[at]), *part.columns], names=["list", "p", *part.schema.names])

    return found.select("uid", "shape", "words", "meta").mapInArrow(search, f"list string, p double, uid long, {_FEATURES}")


def train(
    found: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    most: int = MOST,
    sure: float = SURE,
    rounds: int = 3,
) -> Model:
    """The co-trained model. ``found``: the written features; ``labels``: doc_id, quality, toxic.

    Labels of repeated ids count once (the greater); null labels count as
    unlabelled, labels without an id or a document do not count. Of documents that
    repeat an id one is learnt from.
    """
    each = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.col("quality").cast("double")).alias("quality"), F.max(F.col("toxic").cast("double")).alias("toxic")
    )
    each = written(each.where("quality is not null or toxic is not null"), "quality-labels")
    near = F.xxhash64("id", F.lit(9))
    chosen = each.join(found.select("id"), "id", "left_semi").orderBy(near, "id").limit(max_labelled)
    chosen = written(chosen, "quality-chosen")  # the broadcast is bounded by max_labelled rows
    fitted = found.select("id", "uid", "shape", "words", "meta").join(F.broadcast(chosen), "id").orderBy("id", "uid").toArrow().combine_chunks()
    # Of documents that repeat an id the first; as arrays, since lists of numbers would take several times the memory.
    ids, first = np.unique(fitted["id"].to_numpy(), return_index=True)
    fitted = fitted.take(pa.array(first))
    columns = [[x.values.to_numpy() for x in fitted[c]] for c in ("shape", "words", "meta")]
    raw = np.array(columns[0], float).reshape(-1, SHAPES)
    mean = raw.mean(0) if len(raw) else np.zeros(SHAPES)
    scale = np.maximum(raw.std(0), 1e-3) if len(raw) else np.ones(SHAPES)
    trainers = {}
    for target in ("quality", "toxic"):
        given = fitted[target].to_pylist()
        trainer = CoTraining([Row(np.array(s, float), np.array(w, np.int64), np.array(m, np.int64), float(y)) for s, w, m, y in zip(*columns, given) if y is not None], mean, scale)
        if trainer.ready:
            trainer.learn(200)
            trainers[target] = trainer
    if trainers:
        labelled = found.sparkSession.sparkContext.broadcast(Marks.of(found.select("id", "uid").join(each.select("id"), "id", "left_semi")))
        taken: set[int] = set()
        for _ in range(rounds):
            surest = written(_surest(found, trainers, most, sure, taken, labelled), "quality-surest")
            lists = [f"{target}/{view}/{side}" for target in trainers for view in ("text", "meta") for side in (1, 0)]
            chosen_uids = {}
            for name in lists:  # each task sends at most ``most`` numbers, and the features of the chosen alone follow
                mine = surest.where(F.col("list") == name).select("p", "uid").orderBy(F.desc("p"), F.xxhash64("uid"), "uid").limit(most)
                chosen_uids[name] = [r["uid"] for r in mine.collect()]
            uids = sorted({u for own in chosen_uids.values() for u in own})
            features_of = {r["uid"]: r for r in surest.where(F.col("uid").isin(uids)).dropDuplicates(["uid"]).collect()} if uids else {}
            for name in lists:
                target, view, side = name.split("/")
                trainers[target].teach(view, [_row(features_of[u], float(side)) for u in chosen_uids[name]])
            for trainer in trainers.values():
                trainer.learn(40)
            taken |= set(uids)
    views = {t: trainers[t].view() if t in trainers else None for t in ("quality", "toxic")}
    return Model(mean, scale, views["quality"], views["toxic"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, carry: list[str] | None = None, **bounds) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, lang, source, n_chars; columns ``carry``, all by default) with quality_score, toxic_score and ``keep``.

    Columns of these three names are replaced. Null text counts as empty, null
    metadata as a value of its own; very long texts are read whole. Without labels
    of both kinds the quality is 1 and the toxicity 0, so all rows stay. Repeated
    rows are scored each, rows without an id too; an empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("quality_score", "toxic_score", "keep")]
    with working_tables():
        fitted = train(features(docs), labels, **bounds)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    names = [f"__c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], *_inputs(docs))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, buckets = model.value, Buckets()
        for b in pieces_of(batches):
            text, meta = _views(pa.RecordBatch.from_arrays(_measured(b, buckets), names=["shape", "words", "meta"]), own.mean, own.scale)
            scores = [pa.array(np.full(b.num_rows, default) if v is None else v.scores(text, meta)) for v, default in ((own.quality, 1.0), (own.toxic, 0.0))]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *scores], names=[*names, "quality_score", "toxic_score"])

    scored = rows.mapInArrow(score, f"{kind}, quality_score double, toxic_score double")
    scored = scored.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "quality_score", "toxic_score")
    return scored.withColumn("keep", (F.col("quality_score") >= threshold) & (F.col("toxic_score") < threshold))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of ``documents`` by a model trained on ``labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, carry=["doc_id"])
