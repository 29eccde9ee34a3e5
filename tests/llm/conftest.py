from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, hub string, key string"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators use inside."""
    base = words(1, 60)
    near = base[:30] + ["changed"] + base[31:]
    rows = [
        (0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "ONE two"),
        (8, "Émile naïve \U0001f600 # | <x>\nsame line here\nsame line here\n"), (9, " ".join(words(2, 30_000))), (10, "x" * 40_000), (11, "a b c a b c a b c d"), (6, "one two"), (12, "<|endoftext|> # #"),
    ]
    full = [(i, t, "en", None if i % 5 == 3 else f"s{i % 3}", None, "r", 1, "h", "k") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
