from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component string, band int, a string, key string, rank int, base string, spans string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Texts that are null, empty, blank, very short, very long, equal, near copies and repeated rows, with a null id."""
    rng = random.Random(5)
    body = words(rng, 120)
    near = body[:]
    near[60] = "changed"
    passage = words(rng, 70)
    texts = [None, "", "  \t\n ", "one two", "One  TWO", "a", "é ñ 漢字 \U0001f600", "x" * 200_000, " ".join(words(rng, 30_000)), " ".join(body), " ".join(body).upper(), " ".join(near)]
    texts += [" ".join(words(rng, 80) + passage + words(rng, 40)) for _ in range(3)]
    texts += ["idiot " * 100, "1.2.3.4 a@b.c +1 (555) 123-4567, card 4539 1488 0343 6467"]
    rows = [(i, t, "en" if i % 2 else "fr", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, " ".join(body), "en", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, 0.5, "c", 1, "a", "k", 1, "b", "s") for r in odd_rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
