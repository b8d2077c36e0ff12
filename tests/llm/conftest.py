import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghiklmnoprstuvw") for _ in range(draw.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Plain, repeated, edited, empty, null, blank, short and long texts."""
    long_ = words(1, 3000)
    edited = words(2, 200).split()
    edited[100] = "changed"
    return [
        words(2, 200), words(2, 200), " ".join(edited), words(3, 120), words(4, 90) + " " + words(3, 120),
        "", None, "   \n", "one", "one two", "One TWO", long_, long_ + " end", "ünï çödé " + words(5, 40),
        "a\x00b c", "x" * 5000, words(6, 60) + "\n" + words(6, 60),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids; one id twice, one null, and a column whose name may clash."""
    rows = [(i, t, "en", "src0", len(t or ""), "x") for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "src0", len(texts[0]), "x"), (None, texts[3], None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", score string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
