"""Operator 7, line dedup: sharded cuckoo filters over exact reference counts.

``LineIndex`` holds three tables on shared files, each by shard of the line's hash:

* postings (k1, k2, doc_id): each document's different long lines, by a 128-bit hash;
* counts (k1, k2, owner, documents): the lines of two documents or more, exactly;
* filters (data): a cuckoo filter over the counted lines of a shard.

``insert`` and ``delete`` read and write the shards of the affected lines alone
and add or remove exactly those keys in the filters whose line became or ceased
to be shared, so inserting documents and deleting them again restores the index.
A filter that is full is made anew from its shard's counts; when shards hold
twice what they should, their number doubles.

``apply`` keeps postings that a filter lets pass, joins them with the exact
counts, and drops the lines of all documents but the owner. The filters go to
the tasks for as many shards at a time as ``FILTER_BYTES`` hold, and each such
group reads its own postings, so they work at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import join_hot, new_folder, written

LEAST = 10
FILTER_BYTES = 32 << 20
PER_SHARD = 200_000
#: Tasks that a shard's postings are dealt to, as a line may be in a third of all documents.
SPREAD = 16
_SPACE = b" \t\n\x0b\x0c\r"
#: The document of all rows with a null id; never an owner beside another.
_NO_ID = 2**63 - 1


def line_key(line: bytes) -> bytes | None:
    """The key of a line, None if it is too short to count."""
    key = line.strip(_SPACE).lower()  # of bytes: A-Z alone
    if len(key) < LEAST or not key.isascii() and len(key.decode()) < LEAST:
        return None
    return key


def _hashes(text: bytes) -> list[int]:
    """128-bit hashes of a text's different long lines."""
    keys = {k for k in map(line_key, text.split(b"\n")) if k is not None}
    return [xxhash.xxh3_128_intdigest(k) for k in keys]


def _halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in hashes), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class CuckooFilter:
    """Four 16-bit prints in each bucket, at one of two places; supports deletion."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, data: bytes | None = None):
        self.n = buckets  # a power of two
        self.slots = np.zeros((buckets, self.SLOTS), "<u2") if data is None else np.frombuffer(data, "<u2").reshape(-1, self.SLOTS).copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(keys / cls.SLOTS / 0.85).bit_length()))

    @classmethod
    def loaded(cls, data: bytes) -> CuckooFilter:
        return cls(len(data) // (2 * cls.SLOTS), data)

    def places(self, k1, k2):
        """Print and both buckets of keys given as signed halves (arrays)."""
        mark = np.maximum(k2.astype("<i8").view("<u8") & np.uint64(0xFFFF), np.uint64(1))
        first = (k1.astype("<i8").view("<u8") >> np.uint64(16)) & np.uint64(self.n - 1)
        return mark, first, first ^ self._hop(mark)

    def _hop(self, mark):
        return ((mark * np.uint64(0x5BD1E995)) >> np.uint64(7)) & np.uint64(self.n - 1)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(k1, k2)
        mark = mark.astype("<u2")[:, None]
        return (self.slots[a.astype(np.int64)] == mark).any(1) | (self.slots[b.astype(np.int64)] == mark).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Adds the keys; False if one finds no place (the filter must grow)."""
        marks, a, b = self.places(k1, k2)
        for mark, at, other in zip(marks.tolist(), a.tolist(), b.tolist()):
            if self._put(at, mark) or self._put(other, mark):
                continue
            for kick in range(self.KICKS):
                slot = (mark + kick) % self.SLOTS
                mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
                at ^= int(self._hop(np.uint64(mark)))
                if self._put(at, mark):
                    break
            else:
                return False
        return True

    def _put(self, at: int, mark: int) -> bool:
        row = self.slots[at]
        for s in range(self.SLOTS):
            if row[s] == 0:
                row[s] = mark
                return True
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Removes keys that were inserted."""
        marks, a, b = self.places(k1, k2)
        for mark, at, other in zip(marks.tolist(), a.tolist(), b.tolist()):
            for place in (at, other):
                found = np.flatnonzero(self.slots[place] == mark)
                if len(found):
                    self.slots[place, found[0]] = 0
                    break


def postings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id): the different long lines of each document."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_hashes(t) for t in batch.column("text").to_pylist()]
            k1, k2 = _halves([h for own in lines for h in own])
            ids = np.repeat(batch.column("doc_id").to_numpy(), [len(own) for own in lines])
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ids)], names=["k1", "k2", "doc_id"])

    return rows.mapInArrow(post, "k1 long, k2 long, doc_id long")


def _counts(postings: DataFrame) -> DataFrame:
    """Lines of two documents or more; a repeated row counts, but alone makes no second document."""
    found = postings.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("latest"), F.count(F.lit(1)).alias("documents")
    )
    return found.where("owner < latest").drop("latest")


def _shard(shards: int):
    return F.col("k1").bitwiseAND(F.lit(shards - 1)).cast("int").alias("shard")


def _filter_of(keys: pd.DataFrame) -> pd.DataFrame:
    """(shard, data): a filter of all keys of one shard."""
    room = max(8, len(keys))
    own = CuckooFilter.sized(room)
    while not own.insert(keys["k1"].to_numpy("<i8"), keys["k2"].to_numpy("<i8")):
        room *= 2
        own = CuckooFilter.sized(room)
    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "data": [own.slots.tobytes()]})


def _filter_after(old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """(shard, data) after the changes; no data where the filter is full and must be made anew."""
    shard, data = int((old if len(old) else changes)["shard"].iloc[0]), None
    if len(old):
        own = CuckooFilter.loaded(old["data"].iloc[0])
        halves = lambda c: [changes.loc[changes["change"] == c, k].to_numpy("<i8") for k in ("k1", "k2")]
        own.delete(*halves(-1))
        data = own.slots.tobytes() if own.insert(*halves(1)) else None
    return pd.DataFrame({"shard": [shard], "data": pd.Series([data], dtype=object)})


class Shards:
    """A table in one folder for each shard and writing: shard -> folders. A change writes the shards it touches alone."""

    def __init__(self, spark: SparkSession, schema: str, folders: dict[int, list[str]] | None = None):
        self.spark, self.schema, self.folders = spark, schema, folders or {}

    def read(self, shards: Iterable[int] | None = None, named: bool = False) -> DataFrame:
        """The rows of some shards, or of all; ``named``: with the shard before them."""
        chosen = self.folders if shards is None else [s for s in shards if s in self.folders]
        paths = [p for s in sorted(chosen) for p in self.folders[s]]
        if not paths:
            return self.spark.createDataFrame([], ("shard int, " if named else "") + self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.select(F.regexp_extract("_metadata.file_path", r"shard=(\d+)", 1).cast("int").alias("shard"), "*") if named else rows

    def _write(self, rows: DataFrame, name: str, spread_by: str | None) -> dict[int, list[str]]:
        """Writes rows (with shard) by shard; a shard's rows go to a few tasks."""
        folder = new_folder(self.spark, name)
        salt = [F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))] if spread_by else []
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows.select("shard", *names).repartition("shard", *salt).write.partitionBy("shard").parquet(folder)
        # Which folders came to exist: at most one row for each shard.
        found = self.spark.read.parquet(folder).select("shard").distinct().collect() if not _is_empty(self.spark, folder) else []
        return {r[0]: [f"{folder}/shard={r[0]}"] for r in found}

    def replaced(self, rows: DataFrame, shards: Iterable[int], name: str, spread_by: str | None = None) -> Shards:
        new = self._write(rows, name, spread_by)
        kept = {s: p for s, p in self.folders.items() if s not in set(shards)}
        return Shards(self.spark, self.schema, kept | new)

    def appended(self, rows: DataFrame, name: str, spread_by: str | None = None) -> Shards:
        new = self._write(rows, name, spread_by)
        return Shards(self.spark, self.schema, {s: self.folders.get(s, []) + new.get(s, []) for s in self.folders | new})


def _is_empty(spark: SparkSession, folder: str) -> bool:
    """Whether a write by shard left no shard."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return not any("shard=" in str(f.getPath()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


_POSTINGS, _COUNTS, _FILTERS = "k1 long, k2 long, doc_id long", "k1 long, k2 long, owner long, documents long", "data binary"


class LineIndex:
    """Postings, counts and filters by shard. ``shards`` is a power of two: a key's shard is the low bits of its hash."""

    def __init__(self, postings: Shards, counts: Shards, filters: Shards, shards: int, per_shard: int):
        self._postings, self._counts, self._filters, self.shards, self.per_shard = postings, counts, filters, shards, per_shard

    postings = property(lambda self: self._postings.read())
    counts = property(lambda self: self._counts.read())

    filters = property(lambda self: self._filters.read(named=True))

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_shard: int = PER_SHARD) -> LineIndex:
        postings = written(postings_of(docs, id_col, text_col), "line-postings")
        return cls._of(postings, written(_counts(postings), "line-counts"), per_shard)

    @classmethod
    def _of(cls, postings: DataFrame, counts: DataFrame, per_shard: int) -> LineIndex:
        spark = postings.sparkSession
        shards = 1 << max(0, math.ceil(math.log2(max(1, counts.count() / per_shard))))
        shard = _shard(shards)
        filters = counts.select(shard, "k1", "k2").groupBy("shard").applyInPandas(_filter_of, "shard int, data binary")
        return cls(
            Shards(spark, _POSTINGS).appended(postings.withColumn("shard", shard), "line-postings", "doc_id"),
            Shards(spark, _COUNTS).appended(counts.withColumn("shard", shard), "line-counts"),
            Shards(spark, _FILTERS).appended(filters, "line-filters"),
            shards,
            per_shard,
        )

    def _moved(self, postings: Shards, touched: DataFrame) -> LineIndex:
        """The index with new postings, of which only ``touched`` (k1, k2) may count differently."""
        shard = _shard(self.shards)
        touched = written(touched.select("k1", "k2").distinct().withColumn("shard", shard), "line-touched")
        now_in = [r[0] for r in touched.select("shard").distinct().collect()]  # at most one row for each shard
        keys = touched.select("k1", "k2")
        held = self._counts.read(now_in)
        was = held.join(keys, ["k1", "k2"], "left_semi")
        now = written(_counts(postings.read(now_in).join(keys, ["k1", "k2"], "left_semi")), "line-now")
        counts = self._counts.replaced(held.join(keys, ["k1", "k2"], "left_anti").unionByName(now).withColumn("shard", shard), now_in, "line-counts")
        added = now.join(was, ["k1", "k2"], "left_anti").select(shard, "k1", "k2", F.lit(1).alias("change"))
        gone = was.join(now, ["k1", "k2"], "left_anti").select(shard, "k1", "k2", F.lit(-1).alias("change"))
        changes = written(added.unionByName(gone), "line-changes")
        # Only the filters of shards with changes, and only the changes, go to a task.
        changed_in = [r[0] for r in changes.select("shard").distinct().collect()]
        old = self._filters.read(changed_in, named=True)
        new = written(old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_filter_after, "shard int, data binary"), "line-filters")
        full = [r[0] for r in new.where("data is null").select("shard").collect()]
        again = counts.read(full).select(shard, "k1", "k2").groupBy("shard").applyInPandas(_filter_of, "shard int, data binary")
        filters = self._filters.replaced(new.where("data is not null").unionByName(again), changed_in, "line-filters")
        after = LineIndex(postings, counts, filters, self.shards, self.per_shard)
        if counts.read().count() > 2 * self.per_shard * self.shards:  # all shards split
            return LineIndex._of(after.postings, after.counts, self.per_shard)
        return after

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with more documents: their postings are appended, the counts of their lines' shards written anew."""
        new = written(postings_of(docs, id_col, text_col), "line-postings")
        return self._moved(self._postings.appended(new.withColumn("shard", _shard(self.shards)), "line-postings", "doc_id"), new)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without some documents: the shards with lines of theirs are written anew."""
        gone = ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id")).distinct()
        touched = written(self.postings.join(gone, "doc_id", "left_semi").select("k1", "k2"), "line-gone")
        now_in = [r[0] for r in touched.select(_shard(self.shards)).distinct().collect()]
        kept = self._postings.read(now_in).join(gone, "doc_id", "left_anti").withColumn("shard", _shard(self.shards))
        return self._moved(self._postings.replaced(kept, now_in, "line-postings", "doc_id"), touched)

    def passing(self) -> DataFrame:
        """Postings that may be counted, by the filters: as many shards at a time as ``FILTER_BYTES`` hold, one at least."""
        sizes = {r[0]: r[1] for r in self.filters.select("shard", F.length("data")).collect()}
        spark, shards, parts, group, held = self._filters.spark, self.shards, [], [], 0
        for s in [*sorted(sizes), None]:
            if group and (s is None or held + sizes[s] > FILTER_BYTES):
                parts.append(self._probed(spark, group, shards))
                group, held = [], 0
            if s is not None:
                group.append(s)
                held += sizes[s]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _POSTINGS)

    def _probed(self, spark: SparkSession, group: list[int], shards: int) -> DataFrame:
        filters = self._filters.read(group, named=True).collect()  # within FILTER_BYTES, or one shard's
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in filters})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {s: CuckooFilter.loaded(d) for s, d in sent.value.items()}
            for batch in batches:
                k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
                keep, shard = np.zeros(len(k1), bool), k1 & (shards - 1)
                for s, f in own.items():
                    at = np.flatnonzero(shard == s)
                    keep[at] = f.contains(k1[at], k2[at])
                yield batch.filter(pa.array(keep))

        return self._postings.read(group).mapInArrow(probe, _POSTINGS)

    def drops(self) -> DataFrame:
        """(doc_id, dropped): the hashes of the lines that each document loses, as pairs k1, k2 in turn."""
        counts = self.counts
        lost = join_hot(self.passing(), counts, ["k1", "k2"], "documents", ["doc_id"]).where("doc_id > owner")
        return lost.groupBy("doc_id").agg(F.flatten(F.collect_set(F.array("k1", "k2"))).alias("dropped"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The documents with the remaining text, and ``n_lines`` and ``n_dropped`` (in place of such columns)."""
        docs = docs.drop("n_lines", "n_dropped")
        drops = self.drops().select(F.col("doc_id").alias("__line_doc"), F.col("dropped").alias("__dropped"))
        joined = docs.join(drops, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)) == F.col("__line_doc"), "left").drop("__line_doc")
        kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        @F.pandas_udf(kind)
        def remaining(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
            out = []
            for text, lost in zip(texts, dropped):
                if lost is None:
                    out.append((text, text.count("\n") + 1, 0))
                    continue
                lost = set(np.asarray(lost, "<i8").tobytes()[i : i + 16] for i in range(0, 8 * len(lost), 16))
                lines = text.encode().split(b"\n")
                keep = [l for l in lines if (k := line_key(l)) is None or xxhash.xxh3_128_intdigest(k).to_bytes(16, "little") not in lost]
                out.append((b"\n".join(keep).decode(), len(lines), len(lines) - len(keep)))
            return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

        # Marked so that no filter above runs it a second time.
        remaining = remaining.asNondeterministic()
        new = joined.withColumn("__new", remaining(F.coalesce(F.col(text_col), F.lit("")), F.col("__dropped")))
        kept = [F.col("__new.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
        return new.select(*kept, F.col("__new.n_lines").alias("n_lines"), F.col("__new.n_dropped").alias("n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the long lines that a document of smaller id holds.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z
    lower-cased; keys of fewer than 10 code points never go. Null text is one
    empty line. Rows that repeat an id are one document. All rows with a null id
    are one document that comes after all others. Other columns stay; columns
    n_lines and n_dropped are replaced. An empty table gives no rows.
    """
    return LineIndex.build(docs, id_col, text_col).apply(docs, id_col, text_col)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) pos from documents),
k as (
  select doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
s as (select key, min(doc_id) owner from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, s.owner is not null and s.owner <> k.doc_id lost from k left join s on k.key = s.key)
select doc_id, count(*) n_lines, count(*) filter (where lost) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) kept_sha256
from m group by doc_id
"""
