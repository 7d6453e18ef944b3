"""Operator 4, document fingerprints: SimHash votes and permuted block tables.

Terms are shingles of five words (fewer words: the whole sequence). Each term's
64-bit hash votes on every bit, weighted by how often the term occurs; a bit is
set when the votes for it are more than half. The votes of two bits share one
64-bit sum, so 32 sums count all 64 bits inside generated code, and each
document leaves the map side as one row.

``search_fingerprints`` finds all index fingerprints within a Hamming radius of
the query fingerprints by permuted block tables: 64 bits in ``blocks`` blocks;
for any pair within radius r some ``blocks - r`` blocks agree, so there is one
table per choice of blocks. Both sides hold different fingerprints only.

Only DataFrame functions are used. Texts are shuffled once, by ranges of ids;
the next document of a range's last row comes from a table of the ranges' heads,
one row each.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import Ranges
from .shared import join_hot, written

WORDS = 5
_LANES = 0x0000000100000001


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the text's word shingles, repeats included; empty without words."""
    parts = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, words)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(many)

    # The one-element outer transform names the hashes, so that they are computed once.
    return F.element_at(F.transform(F.array(hashes), shingles), 1)


def vote(terms: DataFrame, keys: list[str], term: str, name: str) -> DataFrame:
    """SimHash of each key's terms; a null term does not vote, no votes give zero."""
    sums = [F.sum(F.shiftright(F.col(term), j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(32)]
    counted = terms.groupBy(*keys).agg(F.count(term).alias("votes"), *sums)

    def bit(j: int) -> str:
        lane = f"(s{j % 32} & 4294967295)" if j < 32 else f"shiftrightunsigned(s{j % 32}, 32)"
        return f"if(2 * {lane} > votes, shiftleft(1L, {j}), 0L)"

    return counted.select(*keys, F.expr(" | ".join(bit(j) for j in range(64))).alias(name))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of two fingerprints."""
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def hex64(c: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) with their place and the next document's, in descending order of id, then text; nulls come last.

    part, place: unique for each row. next_part, next_place, next_text: those of
    the next document, after the last one the first.
    """
    ranges = Ranges.of(docs, parts, nulls_first=True)
    dealt = ranges.dealt(docs)
    by = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    # The first row of each part: its greatest id, combined on the map side to one row per part and task.
    few = dealt if not ranges.whole else dealt.where(ranges.greatest() | (F.col("part") == ranges.count - 1))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")
    heads = written(few.groupBy("part").agg(F.max_by("text", order).alias("head_text")), "fingerprint-heads")
    # One row for each range, whose number is a setting: the next non-empty part below, below the last one the first.
    down = Window.orderBy(F.desc("part"))
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts_below = heads.select("part", F.coalesce(F.lead("part").over(down), F.max("part").over(everything)).alias("lower"))
    heads = heads.withColumnRenamed("part", "lower")
    below = parts_below.join(heads, "lower")
    rows = dealt.withColumn("place", F.row_number().over(by)).withColumn("lead_text", F.lead("text").over(by))
    # A lead is null after the part's last row alone, as texts are not null.
    last = F.col("lead_text").isNull()
    return rows.join(below, "part").select(
        "doc_id",
        "text",
        "part",
        "place",
        F.when(last, F.col("lower")).otherwise(F.col("part")).alias("next_part"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
        F.when(last, F.col("head_text")).otherwise(F.col("lead_text")).alias("next_text"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likeness, and ``found_id``.

    ``found_id`` is the document (the nearest, then of the smallest id) whose
    fingerprint lies within ``radius`` bits of the edited text's, null if none.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document, in descending id order, after the last
    the first; a single document is its own next. Null text counts as empty; a
    text without words has fingerprint zero. Every row is a document: rows that
    repeat an id follow each other by descending text, rows with a null id come
    last. Very long texts are handled whole. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = with_next(docs, parts).withColumn("n_chars", F.char_length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    pairs = pairs.withColumn(
        "edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))")
    )
    # What the result needs of a document goes along with its votes, so that texts are shuffled once.
    along = ["doc_id", "part", "place", "next_part", "next_place", "n_chars"]
    both = F.array(
        F.struct(F.lit(None).cast("string").alias("edited_sha256"), F.col("text").alias("t")),
        F.struct(F.sha2("edited", 256).alias("edited_sha256"), F.col("edited").alias("t")),
    )
    terms = pairs.select(*along, F.explode(both).alias("v")).select(*along, "v.edited_sha256", shingle_hashes(F.col("v.t")).alias("terms"))
    terms = terms.select(*along, "edited_sha256", F.explode_outer("terms").alias("term"))
    votes = written(vote(terms, [*along, "edited_sha256"], "term", "fp"), "fingerprints")
    own = votes.where("edited_sha256 is null").drop("edited_sha256")
    edited = votes.where("edited_sha256 is not null").select("part", "place", "edited_sha256", F.col("fp").alias("edited_fp"))
    after = own.select(F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("fp").alias("next_fp"))
    out = own.join(edited, ["part", "place"]).join(after, ["next_part", "next_place"])
    # Which documents the edited text would still be found as.
    first = own.groupBy("fp").agg(F.min("doc_id").alias("id"))
    pairs = search_fingerprints(edited.select(F.col("edited_fp").alias("q")), first, radius)
    nearest = pairs.join(first, "fp").groupBy(F.col("q").alias("edited_fp")).agg(F.min(F.struct("distance", "id"))["id"].alias("found_id"))
    counted = edited.groupBy("edited_fp").agg(F.count(F.lit(1)).alias("n"))
    nearest = written(counted.join(nearest, "edited_fp", "left"), "fingerprint-nearest")
    out = join_hot(out, nearest, ["edited_fp"], "n", ["part", "place"])
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex64("fp").alias("fingerprint"),
        hex64("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
        "found_id",
    )


def _block_tables(fps: DataFrame, name: str, radius: int, blocks: int) -> DataFrame:
    """(table, key, name): each different fingerprint under every choice of ``blocks - radius`` blocks."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below blocks")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(2**b for i in kept for b in range(edges[i], edges[i + 1])) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    distinct = fps.where(F.col(name).isNotNull()).select(name).distinct()
    return distinct.select(name, F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))


def search_fingerprints(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (q, fp) of different query and index fingerprints within ``radius`` bits, with ``distance``.

    ``queries`` has a column q, ``index`` a column fp. Nulls find nothing. With
    64 bits in 6 blocks and radius 3, keys have about 32 bits, so few keys meet
    by chance.
    """
    q, i = _block_tables(queries, "q", radius, blocks), _block_tables(index, "fp", radius, blocks)
    found = q.join(i, ["table", "key"]).withColumn("distance", F.expr("bit_count(q ^ fp)"))
    return found.where(F.col("distance") <= radius).select("q", "fp", "distance").distinct()


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents``."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
