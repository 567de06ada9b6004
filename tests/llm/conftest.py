import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    """Invented words: rarely the same, so that only planted copies repeat."""
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Nulls, empties, blanks, copies, near copies, a long text, ties and unusual characters."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(20)]
    near = []
    for t in base[:6]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
        near.append(t.upper().replace(" ", "\n"))
    shared = prose(rng, 90)
    return [
        None, "", "   \n\t ", "one", "two words", "two words", *base, *base[:4], base[0], *near,
        prose(rng, 20) + " " + shared + " " + prose(rng, 20), prose(rng, 25) + " " + shared, shared, prose(rng, 6000), "é" * 900, "é" * 900 + "x",
        "naïve 日本語 text — with “marks”, 12 345 and it's they'll  two  spaces\n\nand lines", "ab " * 300, "same line\nsame line\nother\nsame line",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents table, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows_of(texts), SCHEMA).withColumns({c: F.lit(1) for c in ("words", "key", "n", "row", "kept", "item", "spans", "block", "tid", "whole")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
