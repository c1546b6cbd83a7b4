import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from texts or (doc_id, text) pairs, with a column whose name clashes with results."""

    def build(rows):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOCS)
        for name in ("kept", "key", "fp", "u", "_gone_id", "n", "rank", "bucket", "component_id"):
            df = df.withColumn(name, F.lit("clash"))
        return df.repartition(3)

    return build


PROSE = "the quick brown fox jumps over a lazy dog while seven bright birds sing near the old river mill and children play quietly under tall green trees"


@pytest.fixture(scope="session")
def awkward():
    """Nulls, blanks, a very long text, copies, repeated rows, odd characters, null ids."""
    long_ = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))
    return [(0, None), (1, ""), (2, "  \n\t "), (3, PROSE), (4, PROSE), (4, PROSE), (5, long_), (6, "é ü ß 日本語 \U0001f600 " + PROSE), (None, None), (None, PROSE + " end"), (7, "a"), (8, "\x00\x1f weird   text")]
