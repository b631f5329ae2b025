import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns that the operators use inside
CLASHING = ["h", "tokens", "key", "row", "r", "v", "fp", "b1", "d2", "x0", "m0", "label", "limit_source", "threshold", "run_id", "rep", "root", "curve_index"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = "ein langer text mit vielen worten und punkten. " * 20_000
    return [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, "The quick, brown fox jumps over the lazy dog!", "en", "b", 45),
        (3, "", "en", "a", 0),
        (4, None, "en", "a", None),
        (5, "no language here at all", None, "a", 23),
        (6, "no source here at all", "en", None, 21),
        (None, "no identity here at all", "en", "a", 23),
        (None, None, None, None, None),
        (7, long, "de", "b", len(long)),
        (8, "1234 5678 !!! ---", "de", "b", 17),
        (9, " \t\n ", "fr", "c", 4),
        (10, "der schnelle braune fuchs", "de", "b", 25),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """odd_rows with columns of names that clash."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, DOCS).withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def duck():
    """SQL over a DataFrame as the table `documents`."""
    import duckdb

    def run(sql, df, table="documents"):
        con = duckdb.connect()
        con.register(table, df.toArrow())
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        return [dict(zip(names, r)) for r in found.fetchall()]

    return run
