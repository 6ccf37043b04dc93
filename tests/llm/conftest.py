import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, ids string, key string, kept boolean"


def documents(spark, texts, sources=None):
    """Rows with columns whose names clash with those of the operators."""
    rows = [(i, t, None, (sources or {}).get(i, "s"), None, 1, "x", "y", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "\n", "a", "a\n a\tb  c ", "x" * 5000, "é ü 　ﬁ \U0001f600▁ ▁▁b\x00c", "<0x41> <s> <|endoftext|> foo's  can't\r\n\r\n  it ", "word " * 3000, "a\n a\tb  c "]


@pytest.fixture()
def odd(spark):
    return documents(spark, ODD)
