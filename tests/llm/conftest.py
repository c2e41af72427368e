import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, row string"
LONG = " ".join(f"word{i % 977} of" for i in range(40_000))
BASE = "The quick brown fox jumps over the lazy dog and then it runs to the river for a drink of cold water in the evening"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " again", "en", None), (4, None, "en", "a"), (5, "", None, "b"), (6, " \n\t ", "de", "b"), (None, "une phrase sans nom", "fr", "b"),
        (8, LONG, "en", "a"), (9, "x", "en", "c"), (9, "x", "en", "c"), (10, "12 !! 34", None, None), (11, "É ﬁ  中文 \u2028 𝔘 <|endoftext|>", "fr", "c"), (12, "a\u00a0b a\u00a0b " * 30, "es", "c"), (None, None, None, None),
    ]
    return [Row(doc_id=i, text=t, lang=lang, source=s, n_chars=None if t is None else len(t), size="other", kept="other", row="other") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
