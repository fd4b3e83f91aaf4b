import pytest

#: Names that operators use inside, as columns of the caller.
CLASHES = ("_text", "_source", "_lang", "_topic", "_tokens", "_chance", "_key_topic", "_cell_source", "_cell_p", "_id", "_y", "_h", "_k", "t", "_near_id", "_near_key", "probability",
           "node", "root", "class_id", "component_id", "text_key", "sketch", "block", "g", "word", "score", "pieces", "piece_ids", "_1", "a b")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands int, kept string, " + ", ".join(f"`{c}` string" for c in CLASHES)
LONG = "the quick brown fox jumps over a lazy dog while seven wise owls watch from old trees near some quiet river bank " * 3


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    rows = [(1, LONG, "en", "a"), (2, LONG, "en", "a"), (2, LONG, "en", "a"), (3, None, "en", None), (4, "", None, "a"), (None, "one two", "en", "a"),
            (6, "word " * 30_000, "en", "b"), (7, " \n\t ", "de", "b"), (8, LONG.replace("owls", "cats", 1), "en", "a"), (9, "Été 12 mail x.1@y.example.com\n\n" + LONG[:150], None, None)]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0, "k", *["t"] * len(CLASHES)) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
