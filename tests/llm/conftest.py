"""Fixtures of the training-data tests; the session comes from tests/conftest.py."""

from __future__ import annotations

import random

import pytest

WORDS = ["stone", "river", "lamp", "cloud", "paper", "green", "under", "seven", "market", "window",
         "garden", "silver", "engine", "copper", "winter", "summer", "bridge", "letter", "orange", "planet"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from (doc_id, text[, lang[, source]]) rows, with extra
    columns that have names operators use themselves."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, "x", 7) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "score string, key int")
    return make
