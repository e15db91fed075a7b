from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def documents_of(spark):
    """Documents from (doc_id, text) pairs, with a column whose name clashes with names used inside."""

    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, id int"
        )

    return make


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words, repeatable."""

    def make(words: int, seed: int) -> str:
        r = random.Random(seed)
        parts = ["tion", "er", "the", "an", "re", "ou", "st", "in", "ha", "es"]
        said = [" ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(12)) + "." for _ in range(words // 12 + 1)]
        return "\n".join(said)

    return make


# Texts that every operator must take: null, empty, white space, one character, no letters, long runs, other scripts.
ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "1234 5678",
    "x" * 20_000,
    "1" * 20_000,
    "a@" * 3_000,
    "日本語のテキスト。" * 50,
    "é  ü 🙂 <|endoftext|> don't 's",
    "same text here",
    "same text here",
]


@pytest.fixture(scope="session")
def odd(documents_of):
    rows = [*enumerate(ODD_TEXTS), (None, "row without an id"), (10, "same text here")]
    return documents_of(rows)


@pytest.fixture(scope="session")
def empty(documents_of):
    return documents_of([])
