"""Small corpora for the operators' tests."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """rows -> a documents table; rows are (doc_id, text) or (doc_id, text, lang)."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded words of a small language."""

    def make(seed, n, syllables="ba be bi bo bu da de di do du ka ke ki ko ku".split()):
        rng = random.Random(seed)
        return [rng.choice(syllables) + rng.choice(syllables) + rng.choice(["", "n", "s", rng.choice(syllables)]) for _ in range(n)]

    return make
