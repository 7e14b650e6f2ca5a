import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and
    extra columns named like the operators' outputs and helpers."""
    long_text = "\n".join(f"line {i % 700} of a very long text" for i in range(4000))
    rows = [
        (1, "a b c\nd e f\ng h i\nj k l", "en", "s1", 9),
        (1, "a b c\nd e f\ng h i\nj k l", "en", "s1", 9),
        (2, "x\na b c\nd e f\ng h i", "en", "s2", None),
        (2, "other words under the same id", None, "s2", 1),
        (None, "a b c\nd e f\ng h i\nj k l", "en", None, 3),
        (None, None, None, None, None),
        (3, None, "en", "s1", 0),
        (4, "", "en", "s3", 0),
        (5, " \t\n ", "en", "s3", 4),
        (6, long_text, "en", "s1", len(long_text)),
        (7, long_text + " end", "en", "s1", len(long_text) + 4),
        (8, "same\nsame\nsame\nsame\nsame", "de", "s2", 24),
        (9, "one two", "fr", "s2", 7),
        (10, "ÀÉ ß 😀 naïve text", "fr", "s2", 16),
        (-5, "negative id text here", "fr", "s2", 16),
    ]
    extra = "row long, size long, fp string, n_lines string, component_id long, shard string, _row string, copies int"
    rows = [(*r, 7, 8, "f", "n", 9, "s", "_", 1) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return spark.createDataFrame([], edge_docs.schema)
