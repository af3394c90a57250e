import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra
    columns whose names clash with those that operators use inside."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    base = " ".join(r.choice(words) for _ in range(200))
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "fr", None, 3),
        (4, long, "en", "b", 1),
        (5, base, None, "a", 1),
        (6, base, "en", "a", 1),
        (6, base, "en", "a", 1),
        (7, base.replace(" ", "\n"), "en", "b", 1),
        (8, base + " tail", "en", "b", 1),
        (9, "one", "en", "b", 1),
        (None, "one", None, None, None),
        (10, "12 345 !!", "de", "b", 1),
        (11, "All rights reserved. CC BY, cc by-sa; General Public License", "en", "c", 1),
        (12, "end <|endoftext|> and more\u0085\u2028 all rights reserved", "en", "c", 1),
    ]
    return spark.createDataFrame([(*x, "x", 5) for x in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def more_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
