import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

LONG = "word " * 3000 + "x" * 5000


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty and long texts, ties, repeated rows, near and exact copies, shared passages and lines."""
    base = [f"w{i}" for i in range(120)]
    near = base.copy()
    near[60] = "changed"
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, " ".join(base), "a"), (2, " ".join(near), "a"), (3, " ".join(base), "b"), (3, " ".join(base), "b"),
        (4, None, None), (5, "", "a"), (6, "  \t\n ", "b"), (None, "no id here", "c"), (7, LONG, "c"), (8, LONG, "c"),
        (9, f"start of nine {passage} end", "d"), (10, f"{passage} and ten", None), (11, "ÀÉ Straße ÀÉ\nSame Line\nother", "é"),
        (12, "same line \nX", "d"), (13, "\tSAME LINE\r\nY", "d"), (14, "one", "a"), (15, "One", "a"), (16, "two words", "a"),
        (17, f"{passage} {passage}", "b"), (18, "a\x0bb\x0cc\rd", "b"), (19, "emoji 😀 and ſ K", "e"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use inside."""
    rows = [(i, t, s, "x", n, "y", n, 0.5) for n, (i, t, s) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, pos int, signature string, size long, target double").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
