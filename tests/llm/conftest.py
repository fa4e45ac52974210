import duckdb
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# names that operators use for results or inside
CLASHING = ["size", "kept", "fp", "shard", "slot", "copies", "row", "recipe", "score", "lang_pred", "rate", "target", "part", "id"]


@pytest.fixture(scope="session")
def docs_schema():
    return DOCS


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows and a very long text."""
    long_text = "the quick brown fox jumps over the lazy dog and runs away. " * 20_000
    return [
        (1, "the same text here is the same", "en", "a", 30), (2, "the same text here is the same", "en", "b", 30),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \t\n", "fr", "a", 3), (6, long_text, "en", "b", len(long_text)),
        (7, long_text, None, "b", None), (8, "12345 !!!", "en", None, 9), (8, "12345 !!!", "en", None, 9),
        (None, "no number has this text of words", "en", "c", 1), (None, "no number has this text of words", "en", "c", 1),
        (None, None, None, None, None), (9, "été à la plage où nous étions", "fr", "c", 29), (10, "𝔘nicode 🎉 text\u0085here", "en", "c", 5),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def against_sql(spark, sf_dir):
    def compare(name):
        from learnmart.llm import registry

        con = duckdb.connect()
        for table in ("documents", "pages", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        got = registry.queries()[name](spark, sf_dir)
        cols = sorted(got.columns)
        theirs = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.statements()[name]})").fetchall()
        mine = [tuple(r) for r in got.select(cols).collect()]
        assert sorted(map(repr, mine)) == sorted(map(repr, theirs)) and mine

    return compare
