import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text, source, lang) rows; ``extra`` adds columns
    whose names clash with the operators' own."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(*r, *(None,) * (4 - len(r))) for r in rows], "doc_id long, text string, source string, lang string")
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "size", "spans", "score", "h", "node", "root", "k", "i", "block", "target", "_row", "host", "rank"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


HARD = [(1, "a b c d e f g", "s", "en"), (1, "a b c d e f g", "s", "en"), (2, None, None, None), (3, "", "s", "de"), (None, "x y z", "t", "fr"), (4, "w " * 30000, "t", "en"), (5, "y" * 50000, "", "zz")]


@pytest.fixture(scope="session")
def hard():
    return HARD
