import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a column that clashes with operators' own names."""
    long = "long words, " * 40_000 + "end"
    rows = [(0, None), (1, ""), (2, "one"), (3, "one"), (3, "one"), (4, "  two  spaces\tand\n\nlines \u3000 wide\u00a0here  "),
            (5, long), (6, "emoji \U0001F9D1\u200d\U0001F680 été naïve 漢字かな " * 30), (None, "no id"), (7, " "), (8, "x" * 5000), (9, "it's they'll  we've 123 4567 ...!?")]
    return spark.createDataFrame([(i, t, 1, "kept") for i, t in rows], "doc_id long, text string, length int, _text string")
