import random

import pytest

EXTRA = "lang string, source string, n_chars long, score double, size long, h long, `n.n` string, _text string, copy int"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def _sentence(rng, n):
    words = ["the", "of", "and"] * 4 + [a + b + c for a in ("ba", "do", "ke", "mi") for b in ("ra", "lu", "ti", "so", "ne") for c in ("", "n", "st", "ly", "mo")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (id, text) pairs, with columns whose names operators use inside."""

    def table(rows, langs=None):
        full = [
            (i, t, (langs or {}).get(i, "xx"), None if n % 5 == 4 else f"s{n % 3}", None, 0.5, 7, 9, "x", "y", 1)
            for n, (i, t) in enumerate(rows)
        ]
        return spark.createDataFrame(full, SCHEMA)

    return table


@pytest.fixture(scope="session")
def awkward():
    """Null and empty texts, a null id, repeated rows, blank and one-word texts, a very long text."""
    rng = random.Random(5)
    text = _sentence(rng, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, text), (5, text), (6, text), (None, text), (None, None),
        (7, "ab " * 30_000), (8, "é" * 900), (9, _sentence(rng, 4000)), (10, text[:300] + " changed " + text[300:]),
        (11, "x" * 50_000), (12, "\x00\x01 control \x1f"), (13, "İstanbul ǅ 𝒳𝒴 😀"),
    ]


@pytest.fixture(scope="session")
def sentence():
    return _sentence
