import pytest

# Rows every operator must bear: null and empty texts, null ids and sources, repeated rows, ties, a very long text.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (3, "The Quick brown fox jumps over the lazy dog again and once more", "b"),
    (4, None, "b"), (5, "", None), (6, " \t\n\x0b ", "a"), (7, "one two", "a"), (8, "ONE  two", None),
    (None, "one two three four", "a"), (None, None, None), (9, LONG, "a"), (10, LONG + " tail", "c"),
    (11, "ünïcode wörds and no break 日本語 text", "c"), (12, "a b c d e f g h\n" * 4, "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows with extra columns named like outputs of the operators."""
    rows = [(*r, 7, "x", True, 1.5, "row") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard string, kept boolean, "
                                       "score double, row string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
