import pytest

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
BASE = " ".join(f"base{k}" for k in range(60))
EDGE = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "b"),
    (2, BASE, "en", "b"),
    (3, BASE + " tail", "en", None),
    (None, BASE + " tail", "en", None),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t ", "en", "a"),
    (7, LONG, "en", "a"),
    (8, "one", "en", "a"),
    (9, "one", "en", "b"),
    (10, "one two\nthree", "fr", "a"),
    (None, None, None, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves, in other case too.
CLASHES = ["Key", "kept", "SIZE", "_text", "_words", "_key", "n_removed", "class", "h", "place", "unit", "taken", "doc"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns of clashing names."""
    from pyspark.sql import functions as F

    rows = [(*r, len(r[1] or "")) for r in EDGE]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def tables(spark):
    from flowsieve.llm.common import table

    return lambda name: table(spark, "/root/testdata/sf0.001", name)
