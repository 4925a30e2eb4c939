import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `tier` int, `Slot` string, `a.b` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    long = prose(60_000)
    copy = prose(120)
    rows = [
        (1, copy, "en", "a"), (2, copy, "en", "b"), (2, copy, "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, "word", "en", None),
        (None, copy, "en", "a"), (None, None, None, None), (6, long, "en", "a"), (7, "...!!! \n\n", "en", "b"), (8, "x" * 200_000, "en", "b"),
        *((k, prose(80), "en", draw.choice("abc")) for k in range(10, 40)),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, "old", "dot") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
