"""Operator 8 on whole documents: near copies by five-word shingles, one of each group stays.

First the documents' SimHash fingerprints are linked as in ``simhash_dedup``, by
deletion-variant signatures, an equality join and verification on all bits. The
documents that are linked are candidates, and each pair is verified by the exact
Jaccard similarity of the shingle sets. This finds most groups.

A pair that is similar can have fingerprints farther apart, so what is in
different groups then meets by prefix filtering, which loses no pair: shingles
have one order over all documents, and two sets of similarity t share one of the
first n - ceil(t n) + 1 of each, where n is the size of the set. Only these are
indexed. A shared shingle so late in both sets that the rest could not reach t
makes no candidate, as do sets of too different sizes. The order is that of the
shingles' hashes, with those frequent in a sample of documents last; the sample
changes the work, not the result.

Texts travel for few candidates. Each set has a bitmap, of which bit i is the
parity of its shingles with that place. Two bitmaps differ in at most as many
bits as the sets have shingles that are not in both, so where they differ in more
than the similarity allows, the pair goes without a look at the texts.

Copies with the same words are one entry of the index. Each entry first meets
the pivot of its key, the entry with the most shared keys; the groups so found
need no more pairs within them. Keys of at most ``hot`` entries then give all
pairs across groups, larger ones those of growing blocks of pivots, until all
their entries are in one group or every pair across groups was met. So no
candidate is lost, whatever the size of a key; a key costs the square of its
entries only where they stay apart.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import clean_shuffles, collect_garbage, join_hot, keep, pieces_of, small_batches, working_tables, written
from .simhash_dedup import link_fingerprints, simhash

WORDS, SIMILARITY, HOT = 5, 0.8, 64
#: Documents sampled for the order, the count there that makes a shingle frequent, and the most of them.
SAMPLE, FREQUENT, MOST = 10_000, 8, 200_000
_MEMO = 200_000
#: Ids of texts to verify that are sent to all tasks; more are joined.
_SENT_IDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], n: int = WORDS) -> set:
    """Sets of n consecutive words; fewer words make one."""
    return set(zip(*(words[i:] for i in range(n)))) if len(words) > n else {tuple(words)}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


class ShingleHashes:
    """The distinct 64-bit hashes of a text's shingles, sorted; equal shingles have equal hashes."""

    def __init__(self, n: int = WORDS):
        self.n, self.memo = n, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.memo
        if len(known) > _MEMO:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        if len(words) <= self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        count = len(words) - self.n + 1
        h = np.zeros(count, np.uint64)
        for i in range(self.n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + each[i : i + count]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(h ^ h >> np.uint64(32))


def prefix(hashes: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the sorted hashes, frequent ones last, of which similar sets share one."""
    n = len(hashes)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        late = frequent[at] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1]


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of a set: of as many places as it has members or more, a power of two. The place is that of the lowest bits."""
    places = max(64, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """How many members at least are in one of two sets alone, by their bitmaps."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), len(a) * 8
    while n > len(b) * 8:
        n >>= 1
        x = x >> n ^ x & ((1 << n) - 1)
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _word_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _entries(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of each row: doc_id, row, a hash k1, k2 of the words in order, the fingerprint, the set's size and bitmap, its prefix."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ShingleHashes(words)
        for batch in pieces_of(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            split = [words_of(t) for t in texts]
            sets = [own.of(w) for w in split]
            first = [prefix(s, frequent.value, similarity) for s in sets]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            keys = np.frombuffer(b"".join(map(_word_key, split)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]),
                    pa.array(np.array([simhash(t, 3) for t in texts], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(map(bitmap, sets), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *first]).view(np.int64))),
                ],
                names=["doc_id", "row", "k1", "k2", "fp", "size", "bits", "prefix"],
            )

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(index, "doc_id long, row long, k1 long, k2 long, fp long, size int, bits binary, prefix array<long>")


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The sorted hashes of shingles that many different texts of a sample share."""
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-total // SAMPLE)))) == 0)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ShingleHashes(words)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(own.of(words_of(t)).view(np.int64))], names=["h"])

    counts = part.select("text").distinct().mapInArrow(index, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST).select("h").toArrow()  # at most MOST rows
    return np.sort(found["h"].to_numpy().astype(np.int64).view(np.uint64))


def _live(sets: DataFrame) -> DataFrame:
    """(key, doc_id, size, at, n): the prefix shingles that two entries or more share. At: place in the order."""
    shared = sets.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared, "near-keys")
    return sets.select("doc_id", "size", F.posexplode("prefix").alias("at", "key")).join(shared, "key")


def _linked(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: entries with fingerprints linked by ``simhash_dedup``; equal ones are each linked to the least of them."""
    first = written(sets.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "near-fingerprints")
    equal = join_hot(sets.select("doc_id", "fp"), first, ["fp"], "n", ["doc_id"]).where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    links = link_fingerprints(first.select("fp"))
    one = first.select(F.col("fp").alias("a"), F.col("least").alias("x"))
    two = first.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    near = links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(near).distinct()


def _perhaps(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave it open that they are so similar."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    most = (1 - similarity) / (1 + similarity)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = map(least_apart, batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            sizes = zip(batch.column("size_a").to_pylist(), batch.column("size_b").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array([d <= most * (x + y) + 1e-6 for d, (x, y) in zip(apart, sizes)], pa.bool_()))

    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(check, "a long, b long")


def _texts(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id and text of the entries in ``pairs``."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    few = ids.count() <= _SENT_IDS
    some = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            keys = np.frombuffer(b"".join(_word_key(words_of(t)) for t in batch.column("text").to_pylist()), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["doc_id", "text", "k1", "k2"])

    # Of rows that repeat an id the one that is the entry.
    keyed = some.select("doc_id", "text").mapInArrow(key, "doc_id long, text string, k1 long, k2 long")
    own = sets.select("doc_id", F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    own = own.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return keyed.join(own, "doc_id").where("k1 = e1 and k2 = e2").dropDuplicates(["doc_id"]).select("doc_id", "text")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are at least so similar."""
    pairs = written(_perhaps(pairs, sets, similarity), "near-perhaps")
    texts = _texts(docs, pairs, sets)
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: OrderedDict[int, set] = OrderedDict()  # the last few: one entry meets many

        def of(i: int, text: str | None) -> set:
            own = sets.get(i)
            if own is None:
                own = sets[i] = shingles(words_of(text), words)
                if len(sets) > 32:
                    sets.popitem(last=False)
            return own

        for batch in batches:
            x, y = (map(of, batch.column(i).to_pylist(), batch.column(f"text_{i}").to_pylist()) for i in "ab")
            yield batch.select(["a", "b"]).filter(pa.array([jaccard(p, q) >= similarity for p, q in zip(x, y)], pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _joined(live: DataFrame, linked: DataFrame, likely: Callable[..., Column], verified: Callable[[DataFrame], DataFrame], hot: int, growth: int = 16) -> DataFrame:
    """(node, root) of all links among ``linked`` (a, b) and between entries that share a key. ``live``: key, doc_id, size, at, n.

    The pairs of ``linked`` come first. Of keys with several groups then each entry meets the pivot of its key, the one with the most shared
    keys. Then keys of at most ``hot`` entries give all pairs, larger ones those
    of blocks of pivots, each block ``growth`` times the last, until every entry
    was one or the key's entries are all in one group. Pairs in one group are
    never met again, and no other is left out.
    """
    tested = written(linked, "near-candidates")
    collect_garbage(live.sparkSession)
    edges = written(verified(tested), "near-edges")
    collect_garbage(live.sparkSession)
    roots = written(connected_components(edges), "near-roots")
    collect_garbage(live.sparkSession)

    def open_keys(rows: DataFrame) -> DataFrame:
        """The rows of keys with more than one group, with their group."""
        rows = rows.drop("root").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        groups = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        return rows.join(groups.select("key"), "key", "left_semi")

    degree = live.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    live = written(open_keys(live.join(degree, "doc_id")), "near-degrees")
    pivots = live.groupBy("key").agg(F.min_by(F.struct("doc_id", "size", "at", "root"), F.struct(-F.col("degree"), F.col("doc_id"))).alias("p"))
    pivots = pivots.select("key", F.col("p.doc_id").alias("x"), F.col("p.size").alias("size_x"), F.col("p.at").alias("at_x"), F.col("p.root").alias("own"))
    stars = live.join(pivots, "key").where((F.col("root") != F.col("own")) & likely("size", "at", "size_x", "at_x")).select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b"))
    new = written(stars.distinct().join(tested, ["a", "b"], "left_anti"), "near-candidates")
    tested = tested.unionByName(new)
    collect_garbage(live.sparkSession)
    more = written(verified(new), "near-edges")
    collect_garbage(live.sparkSession)
    edges = edges.unionByName(more)
    roots = written(connected_components(edges), "near-roots")

    collect_garbage(live.sparkSession)
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "doc_id"))
    now = written(open_keys(live).withColumn("rank", order).select("key", "doc_id", "size", "at", "n", "rank", "root"), "near-open")
    # The pivots of rank 1 have met all.
    first, block = 2, growth
    while not now.isEmpty():
        collect_garbage(live.sparkSession)
        last = first + block - 1
        turn = F.col("rank").between(first, last) | (F.col("n") <= hot) & (F.col("rank") >= first)
        x = now.where(turn).select("key", F.col("doc_id").alias("x"), F.col("rank").alias("turn"), F.col("root").alias("own"), F.col("size").alias("size_x"), F.col("at").alias("at_x"))
        pairs = now.join(x, (now["key"] == x["key"]) & (now["rank"] > x["turn"]) & (now["root"] != x["own"]) & likely("size", "at", "size_x", "at_x"))
        pairs = pairs.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()
        new = written(pairs.join(tested, ["a", "b"], "left_anti"), "near-candidates")
        tested = tested.unionByName(new)
        more = written(verified(new), "near-edges")
        collect_garbage(live.sparkSession)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = written(connected_components(edges), "near-roots")
        # An entry of the last rank has met all before it.
        now = written(open_keys(now.where((F.col("n") > hot) & (F.col("n") > last + 1))), "near-open")
        first, block = last + 1, block * growth
    return roots


def near_copy_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(doc_id, first): each document and the smallest id of its group of near copies. ``docs``: doc_id, text."""
    small_batches(docs.sparkSession)
    clean_shuffles(docs.sparkSession)
    collect_garbage(docs.sparkSession)
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    entries = written(_entries(docs, words, similarity), "near-entries")
    classes = written(entries.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("e")).select("k1", "k2", "e.doc_id", "e.row"), "near-classes")
    # An id whose rows have different words is one entry.
    chosen = classes.groupBy("doc_id").agg(F.min("row").alias("row")).select("row")
    sets = written(entries.join(chosen, "row", "left_semi").drop("row"), "near-sets")

    def likely(size: str, at: str, size_x: str, at_x: str) -> Column:
        """Whether sets that first meet at these places may be similar: the sizes, and what can follow, allow it."""
        both = f"least({size} - {at}, {size_x} - {at_x})"
        sizes = f"least({size}, {size_x}) >= {similarity} * greatest({size}, {size_x}) - 1e-6"
        return F.expr(f"{sizes} and {both} >= {similarity} / (1 + {similarity}) * ({size} + {size_x}) - 1e-6")

    roots = _joined(written(_live(sets), "near-live"), _linked(sets), likely, lambda pairs: _verified(pairs, docs, sets, words, similarity), hot)
    named = classes.join(roots, classes["doc_id"] == roots["node"], "left").select("k1", "k2", F.coalesce("root", "doc_id").alias("first"))
    return entries.join(named, ["k1", "k2"]).select("doc_id", "first")


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) whose id is the smallest of its group.

    Null text counts as empty; texts without words are copies of each other.
    Rows with a null id stay. Rows that repeat an id go together: all stay unless
    one of them has a smaller near copy. An empty table gives no rows.
    """
    with working_tables():
        groups = near_copy_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), words, similarity, hot)
        gone = keep(groups.where("doc_id <> first").select("doc_id").distinct(), "near-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
