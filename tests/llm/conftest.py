import pytest

SENTENCE = "The harbour office kept every ledger that the captains had signed before the winter of that year. "


@pytest.fixture(scope="session")
def docs(spark):
    """Ordinary, null, empty, repeated and near-copy rows, with extra columns whose names operators use themselves."""
    long = SENTENCE + " ".join(f"word{i} stands here." for i in range(80))
    rows = [(1, long, "en"), (2, None, "en"), (3, "", "en"), (4, long, "fr"), (4, long, "fr"), (5, long.replace("word7 ", "term7 "), "de"),
            (6, "one two", "en"), (7, "### *** ### " * 40, "en"), (None, long, "en"), (8, "Released under the MIT License. mit license\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH x) AND BSD-3-Clause */", "en"),
            (9, "x" * 1500 + " <|endoftext|> y " + "é" * 700, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("*", "'a' AS source", "0L AS n_chars", "1.5D AS score", "'k' AS kept", "7L AS size", "'r' AS row", "1 AS fp0")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
