import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their own columns.
CLASHES = ("score", "size", "shard", "matches", "_found", "_key", "_part", "_words", "_kept", "_matches", "fp", "key", "h", "part", "at", "kept", "held_out", "lang_pred", "component_id", "block", "label")


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, lang]); clash: with further columns of operators' own names."""

    def run(rows, clash=False):
        df = spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows], SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in CLASHES})
        return df

    return run


@pytest.fixture(scope="session")
def sample(spark):
    """The documents of the small test data."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Null id and text, empty and blank texts, odd white space, repeats, ties and a very long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "a b c a b c a b c"), (6, "a b c a b c a b c"), (None, "x\x0by\x0cz\r\nw"), (None, None), (7, "Ünï çödé 漢字 \U0001f600"), (8, "word " * 60000), (9, "A" * 50000), (10, "> quoted\n<b>&amp;</b>")]
