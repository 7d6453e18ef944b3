import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Lange Zeile mit vielen Wörtern und\tTabs\n" * 6000
#: Nulls in every column, empty and very long texts, ties, repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 6),
    (4, "same words in both of these texts here", "en", "a", 38),
    (4, "same words in both of these texts here", "en", "a", 38),
    (5, "Same words in both of\tthese texts here", "en", "b", 38),
    (6, "samewordsinbothofthesetextshere", "en", "b", 31),
    (7, LONG, "de", "b", len(LONG)),
    (8, LONG + "und ein Ende", "de", "b", len(LONG) + 12),
    (9, "é ﬁ 中文 😀 <|endoftext|> don't  stop", None, "c", None),
    (10, "x" * 70000, "en", "c", 70000),
    (11, "one\n\none\nOne two three four\n", "en", "c", 27),
]
CLASH = "n h key fp start length slot n_lines keep topic norm bucket place range path a b term weight text_sha256 quality_score".split()


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def null_id(spark):
    return spark.createDataFrame([(None, "a text without an id, ten words or so in it", "en", "a", 1), (1, "other", "en", "a", 5)], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]
