"""Small tables of hard cases, shared by all tests of the subpackage."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, items int, score string"


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghiklmnorstuv") for _ in range(pick.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def hard_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows, clashing columns."""
    a, b = prose(1, 80), prose(2, 120)
    texts = [
        (1, a), (2, a), (3, a.upper() + "!"), (4, b), (5, b + " one more"), (6, None), (7, ""), (8, " \n\t "),
        (9, "one two"), (9, "one two"), (10, prose(3, 20_000)), (11, "x" * 50_000), (None, a), (None, None),
        (12, "é😀 " * 30 + "Ωmega 12 ½"), (13, prose(4, 30) + " " + a + "\n" + a), (14, prose(5, 25) + " " + " ".join(b.split()[:40])),
    ]
    rows = [(i, t, "en", f"s{n % 3}", len(t or ""), "clash", n, "clash") for n, (i, t) in enumerate(texts)]
    rows[1] = (2, a, None, None, None, None, None, None)
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
