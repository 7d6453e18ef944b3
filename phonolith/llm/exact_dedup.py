"""Operator 1, exact dedup: an extendible-hash index on shared files.

An entry of the index is one different normalised text with the 64-bit hash of
its bytes. The directory maps the leading bits of a hash to a bucket; it starts
with one bucket and doubles: a bucket with more than ``capacity`` entries splits
on the next bit until its parts fit. Each bucket is a range of hashes and has
one owner task, which gets all entries of the range, compares their whole bytes,
chains different texts of one hash, and writes them to the bucket's own files.

``insert`` sends new texts to the owners of the buckets they fall in, which read
their files, append, and split where a bucket is overfull; other buckets keep
their files. The members (document, hash, place in the chain) find their group
in the buckets' files.

Only DataFrame functions are used. The number of rows of each hash is known from
a first pass over the hashes; texts of hashes with very many rows are combined
on the map side before they go to the owner. The directory has at most
``2**depth`` rows, which bounds its broadcast.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import join_hot, new_folder, written

SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null id; above any 64-bit id, so that (code points, id) fits in one decimal.
_NO_ID = 2**64
#: Rows of one hash are combined on the map side from one in so many of all rows on: at most so many hashes.
HOT = 1000
_GROUPS = "h long, chain int, norm string, text_sha256 string, size long, most int, keep_id long"
_MEMBERS = "doc_id long, h long, chain int"


def _const(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _rank(n: Column, doc_id: Column) -> Column:
    """(n, -id) as one decimal: a fixed-width buffer keeps its maximum a hash aggregate over the texts."""
    return _wide(_wide(_wide(n) * _const(2 * _NO_ID)) - F.coalesce(_wide(doc_id), _const(_NO_ID)))


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _slot(h: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - depth).cast("int") if depth else F.lit(0)


def directory(slots: DataFrame, capacity: int, depth: int) -> DataFrame:
    """(bucket, depth, prefix, n) of the buckets that result from splitting until each fits, ``depth`` bits at most.

    ``slots``: slot (the leading ``depth`` bits), n entries, and ``base``, the depth
    that the slot's bucket has already. ``bucket`` numbers the leading bits, with a
    one before them.
    """
    levels = slots.select("slot", "n", F.explode(F.sequence(F.col("base"), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - depth)"))
    full = written(levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n")), "exact-levels")
    over = full.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    over = over.where(F.col("depth") <= depth)
    # A bucket is what fits, or cannot split further, below a parent that does not fit.
    least = slots.select(F.col("base").alias("depth"), F.expr(f"shiftright(slot, {depth} - base)").alias("prefix")).distinct()
    born = full.join(over.unionByName(least).distinct(), ["depth", "prefix"])
    fits = born.where((F.col("n") <= capacity) | (F.col("depth") == depth))
    return fits.select(F.expr("shiftleft(1L, depth) + prefix").alias("bucket"), "depth", "prefix", "n")


class ExactIndex:
    """The index: ``buckets`` (bucket, depth, prefix, n, owner, generation), and the files of its groups and members."""

    def __init__(self, spark: SparkSession, root: str, capacity: int | None, depth: int | None):
        self.spark, self.root, self.capacity, self.least_depth = spark, root, capacity, depth
        self.generation, self.depth = 0, 0
        self.buckets: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int | None = None) -> ExactIndex:
        """``capacity``: entries of a bucket, by default such that there are a few buckets for each shuffle partition."""
        spark = docs.sparkSession
        index = cls(spark, new_folder(spark, "exact-index"), capacity, max_depth)
        return index.insert(docs, id_col, text_col)

    def _folder(self, kind: str, generation: int) -> str:
        return f"{self.root}/{kind}-{generation}"

    def _read(self, kind: str, schema: str) -> DataFrame:
        """All files of a kind; of the groups those alone that the directory names."""
        if kind == "members":
            return self.spark.read.schema(schema).parquet(*[self._folder(kind, g) for g in range(1, self.generation + 1)])
        parts = []
        for g in range(1, self.generation + 1):
            now = self.buckets.where(F.col("generation") == g).select("bucket")
            parts.append(self.spark.read.schema(f"{schema}, bucket long").parquet(self._folder(kind, g)).join(F.broadcast(now), "bucket", "left_semi"))  # at most 2**depth rows
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def groups(self) -> DataFrame:
        """h, chain, norm, text_sha256, size, most, keep_id, bucket of each different text."""
        return self._read("groups", _GROUPS)

    def _slots(self, buckets: DataFrame, depth: int) -> DataFrame:
        """(slot, bucket, ...) of the directory doubled to ``depth``."""
        first = F.expr(f"shiftleft(prefix, {depth} - depth)")
        last = F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1")
        return buckets.withColumn("slot", F.explode(F.sequence(first.cast("int"), last.cast("int"))))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ExactIndex:
        """The index with more documents; this one stays as it is."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        entries = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.char_length(text).alias("n"))
        entries = entries.withColumn("h", F.xxhash64("norm"))
        # First pass: the hashes alone.
        rows = written(entries.select("doc_id", "h"), "exact-rows")
        hashes = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")), "exact-hashes")
        all_rows, new_hashes = hashes.agg(F.sum("rows"), F.count(F.lit(1))).first()
        all_rows = all_rows or 0

        after = ExactIndex(self.spark, self.root, self.capacity, self.least_depth)
        after.generation = self.generation + 1
        if after.capacity is None:
            after.capacity = max(256, -(-new_hashes // (2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
        held = new_hashes + (self.buckets.agg(F.sum("n")).first()[0] or 0 if self.buckets is not None else 0)
        wanted = min(24, math.ceil(math.log2(max(1, held / after.capacity))) + 4)
        after.depth = max(self.depth, wanted if self.least_depth is None else self.least_depth)
        slot = _slot("h", after.depth)
        # The buckets the new hashes fall in, and the entries these have already.
        if self.buckets is None:
            counted = hashes.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.lit(0))
            old, kept = None, None
        else:
            place = self._slots(self.buckets, after.depth).select("slot", "bucket", F.col("depth").alias("base"))
            touched = written(hashes.select(slot.alias("slot")).distinct().join(F.broadcast(place), "slot").select("bucket").distinct(), "exact-touched")
            old = self.groups().join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
            kept = self.buckets.join(F.broadcast(touched), "bucket", "left_anti")
            every = hashes.select("h").union(old.select("h")).distinct().groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
            counted = every.join(F.broadcast(place.select("slot", "base")), "slot")
        split = directory(written(counted, "exact-slots"), after.capacity, after.depth)
        # Each new or changed bucket has one owner, numbered in the order of the hashes; at most 2**depth rows.
        first = F.expr(f"shiftleft(prefix, {after.depth} - depth)")
        split = split.withColumn("owner", F.row_number().over(Window.orderBy(first)) - 1).withColumn("generation", F.lit(after.generation))
        split = written(split, "exact-directory")
        owners = max(1, split.count())
        place = after._slots(split, after.depth).select("slot", "bucket", "owner")

        entries = entries.withColumn("size", F.lit(1).cast("long")).withColumn("chain", F.lit(None).cast("int"))
        entries = entries.withColumn("best", _rank(F.col("n"), F.col("doc_id"))).withColumnRenamed("n", "most").drop("doc_id")
        merged = [F.max(_wide(F.col("best"))).alias("best"), F.sum("size").alias("size"), F.max("most").alias("most"), F.max("chain").alias("chain")]
        hot = written(hashes.where(F.col("rows") > max(100, all_rows // HOT)).select("h"), "exact-hot")  # at most HOT hashes
        if not hot.isEmpty():
            few = entries.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "norm").agg(*merged)
            entries = entries.join(F.broadcast(hot), "h", "left_anti").unionByName(few)
        if old is not None:
            entries = entries.unionByName(old.withColumn("best", _rank(F.col("most"), F.col("keep_id"))).drop("text_sha256", "keep_id"))
        owned = entries.withColumn("slot", slot).join(F.broadcast(place), "slot").drop("slot").repartitionById(owners, "owner")
        # The owner's work: equal bytes are one entry, different texts of one hash a chain.
        found = owned.groupBy("owner", "bucket", "h", "norm").agg(*merged)
        chain = F.row_number().over(Window.partitionBy("owner", "bucket", "h").orderBy(F.asc_nulls_last("chain"), "norm")) - 1
        keep = _wide(_wide(_wide(F.col("most")) * _const(2 * _NO_ID)) - F.col("best"))
        found = found.withColumn("chain", chain.cast("int")).withColumn("keep_id", F.when(keep < _const(_NO_ID), keep).cast("long"))
        found = found.select("h", "chain", "norm", F.sha2("norm", 256).alias("text_sha256"), "size", "most", "keep_id", "bucket")
        found.write.partitionBy("bucket").parquet(after._folder("groups", after.generation))
        after.buckets = split if kept is None else written(kept.unionByName(split), "exact-directory")
        after._write_members(rows, docs, id_col, text_col)
        return after

    def _write_members(self, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> None:
        folder = self._folder("members", self.generation)
        groups = self.groups()
        chained = written(groups.where("chain > 0").select("h").distinct(), "exact-chained")
        if chained.isEmpty():
            rows.select("doc_id", "h", F.lit(0).alias("chain")).write.parquet(folder)
            return
        # Rows of a hash with several texts find theirs by its bytes.
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("h", F.xxhash64("norm"))
        compared = texts.join(chained, "h", "left_semi").join(groups.select("h", "norm", "chain"), ["h", "norm"]).select("doc_id", "h", "chain")
        rows.join(chained, "h", "left_anti").select("doc_id", "h", F.lit(0).alias("chain")).unionByName(compared).write.parquet(folder)

    def rows(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256, bucket, chain of each document, from the buckets' files."""
        groups = self.groups().select("h", "chain", "keep_id", F.col("size").alias("group_size"), "size", "text_sha256", "bucket")
        found = join_hot(self._read("members", _MEMBERS), groups, ["h", "chain"], "size", ["doc_id"])
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return found.withColumn("kept", kept).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", "chain")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, max_depth: int | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``bucket``, ``chain``.

    Texts are equal when equal without ``[\\x20\\x09-\\x0D]``. The row with the
    most code points stays, then the smallest id. Null text counts as empty; all
    empty texts form one group. Very long texts are compared whole. Repeated rows
    (equal id) count towards ``group_size`` and share ``kept``. A null id never
    stays before another; a group of null ids only has a null ``keep_id`` and its
    rows are kept. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    return ExactIndex.build(docs, id_col, text_col, capacity, max_depth).rows()


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact dedup of ``documents``."""
    found = dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm
  from documents),
g as (
  select norm, count(*) group_size, min({'n': -length(t), 'i': doc_id}).i keep_id from d group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(d.norm) text_sha256
from d join g on d.norm = g.norm
"""
