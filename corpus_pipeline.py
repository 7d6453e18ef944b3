"""A corpus pipeline of five of the operators in ``phonolith.llm``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm import line_dedup, mixing, near_copies, packing, quality
from phonolith.llm.shared import clean_shuffles, collect_garbage, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _begin(spark: SparkSession) -> None:
    """A stage takes over neither shuffle files nor the driver's memory from those before it."""
    clean_shuffles(spark)
    collect_garbage(spark)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null texts are scored as empty ones, rows without an id and repeated rows each
    on their own; without labels all stay. Other columns than those of
    ``documents`` go. An empty table gives an empty one.
    """
    _begin(spark)
    found = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS)
    return found.where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; n_chars follows the text.

    A null text becomes an empty one. Rows that repeat an id are one document,
    rows without an id one that comes last; no row goes. Other columns go.
    """
    _begin(spark)
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Candidates come from operator 8's SimHash links and then, for similar texts
    whose fingerprints are far apart, from prefix filtering; all are verified.
    Texts without words are copies of each other. Rows without an id stay, rows
    that repeat an id stay or go together. Other columns go.
    """
    _begin(spark)
    return near_copies.drop_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn towards tempered shares of source, language and topic.

    A null source or language is a value of its own. Rows that repeat an id share
    their draw, rows without an id are drawn by their text. Other columns go.
    """
    _begin(spark)
    return mixing.sample(docs.select(*COLUMNS), keep=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids packed into windows of 1024; a null text is the end id alone, every row is packed."""
    import public_tokenizers

    _begin(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", classify), ("lines", lines), ("near copies", near_dedup), ("mixing", mix), ("packing", pack)]
#: Similarity, training and sampling are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
