import pytest
from helpers import SF


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids and texts, empty and white texts, copies, repeated rows, a long text, and extra columns with names the operators use themselves."""
    long = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
    rows = [
        (0, "The cat sat on the mat."), (1, "The  cat\tsat on the mat."), (2, "the CAT sat on the mat."), (3, None), (4, ""), (5, " \n\t "),
        (6, long), (7, long + " end"), (8, "ﬁne Ünïcode ßtraße 日本語 😀"), (9, "12 34 !!"), (10, "a"), (10, "a"), (None, "no id here"), (None, None), (11, "The cat sat on the mat."), (12, "▁ marker  kept "),
    ]
    return spark.createDataFrame([(i, t, "x", 1, "y", 2.0, "z", 3) for i, t in rows], "doc_id long, text string, sha string, block int, rep string, score double, __sha string, h int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
