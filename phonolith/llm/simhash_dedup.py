"""Operator 8, SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits and a radius of 2 is cut into two segments of 32 bits,
so that for any link one segment differs by at most one bit. Each fingerprint is
indexed under each segment as it is and under the 32 variants with one bit
wild. Keys that several hold are counted, their members found by the one or two
values of the segment that such a key covers, members of equal keys joined and
the pair verified on all bits. Two members of one wildcard key are taken only with that bit different, so each pair meets at
most once for each segment.

Keys with more than ``hot`` different fingerprints are not paired: the other
segment is indexed in turn with as many wild bits as the radius leaves. All
members of such a key are within the radius of each other, so each is linked to
the least of them alone. This covers the same links with rows in proportion to
the members, whatever their number.

Links join fingerprints, not documents: equal fingerprints count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import join_hot, pieces_of, small_batches, written

HOT = 64
_FULL = 0xFFFFFFFF


def simhash(text: str, words: int) -> int:
    """The contract's fingerprint of one text, unsigned."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    hashed = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) > words else [b" ".join(parts)]
    h = np.fromiter((hashed(g, 42) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        votes += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def simhash_fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long, over word shingles of a text with A-Z lower-cased."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            fps = np.array([simhash(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(hash_batches, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def link_fingerprints(fps: DataFrame, fp: str = "fp", hot: int = HOT) -> DataFrame:
    """(a, b), a < b: edges whose components are those of all pairs within 2 bits."""
    # A given number of partitions, as each row becomes 66; by another hash than that of distinct, whose few tasks would do else.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    seg = F.expr("shiftrightunsigned(fp, 32 * seg) & 4294967295")

    def segments(of: DataFrame) -> DataFrame:
        return of.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).select("fp", "seg", seg.alias("s"))

    # wild -1: the segment as it is.
    variants = segments(distinct.repartition(tasks, F.xxhash64("fp"))).select("seg", "s", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("wild"))
    masked = F.when(F.col("wild") < 0, F.col("s")).otherwise(F.expr("s & ~shiftleft(1L, wild)"))
    keyed = variants.select(F.expr("shiftleft(seg * 33L + wild + 1, 32)").bitwiseOR(masked).alias("key"))
    # Members are counted on the map side first; few keys have more than one.
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")
    slot = F.shiftright("key", 32)  # seg * 33 + wild + 1
    of_slot = [F.floor(slot / 33).cast("int").alias("seg"), (slot % 33 - 1).cast("int").alias("wild")]
    # Members come by the one or two segments that a shared key stands for, so the variants are not dealt out again.
    known = shared.select("key", "n", *of_slot, F.col("key").bitwiseAND(F.lit(_FULL)).alias("s"))
    both = F.expr("if(wild < 0, array(s), array(s, s | shiftleft(1L, wild)))")
    known = known.select("key", "n", "seg", "wild", F.explode(both).alias("s"))
    held = F.max(F.when(F.col("wild") < 0, F.col("n")).otherwise(1)).alias("held")
    known = written(known.groupBy("seg", "s").agg(held, F.collect_list(F.struct("key", "n")).alias("keys")), "simhash-segments")  # 33 keys at most
    live = join_hot(segments(distinct), known, ["seg", "s"], "held", ["fp"]).select("fp", F.inline("keys"))
    live = written(live, "simhash-variants").select("key", "fp", "n", *of_slot)

    few = live.where(F.col("n") <= hot)
    bit = F.expr("if(wild < 0, 0L, shiftrightunsigned(fp, seg * 32 + wild) & 1L)")
    few = few.select("key", "fp", bit.alias("bit"), "wild")
    a = few.where("bit = 0").select("key", F.col("fp").alias("a"))
    b = few.where("bit = 1 or wild < 0").select("key", F.col("fp").alias("b"), "wild")
    pairs = a.join(b, "key").where("(wild >= 0 or a < b) and bit_count(a ^ b) <= 2")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    many = live.where(F.col("n") > hot)
    if many.isEmpty():
        return pairs.distinct()
    # A hot key: its other segment with two wild bits (segment equal) or one (segment with one wild bit).
    two = F.array(*[F.lit(_FULL & ~(1 << i | 1 << j)) for i, j in combinations(range(32), 2)])
    one = F.array(*[F.lit(_FULL & ~(1 << i)) for i in range(32)])
    rest = F.expr("shiftrightunsigned(fp, 32 * (1 - seg)) & 4294967295")
    masks = F.when(F.col("wild") < 0, two).otherwise(one)
    again = many.select("key", "fp", rest.alias("rest"), F.posexplode(masks).alias("pos", "mask"))
    again = again.select("key", "pos", F.col("rest").bitwiseAND(F.col("mask")).alias("sub"), "fp")
    least = again.groupBy("key", "pos", "sub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = again.join(least, ["key", "pos", "sub"]).where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_dedup_components(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable by links of at most 2 bits.

    Null text counts as empty; texts without words have fingerprint zero and
    link like any other; very long texts are read whole. Repeated rows each give a row; a null id is never the
    smallest unless its component has no other. Other columns are ignored; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    fps = written(simhash_fingerprints(docs, words, id_col, text_col), "simhash")
    roots = connected_components(link_fingerprints(fps, hot=hot))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(
        first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots"
    )
    ids = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(first.join(ids, "root").select("fp", "n", "component_id"), "simhash-named")
    return join_hot(fps, named, ["fp"], "n", ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of near copies in ``documents``."""
    return near_dedup_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
