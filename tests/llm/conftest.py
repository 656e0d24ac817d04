import random

import pytest

LETTERS = {"en": ["the", "of", "ing", "tion", "er", "an"], "de": ["der", "sch", "ung", "keit", "ein", "ü"]}


def words(rng, n, lang="en"):
    return ["".join(rng.choices(LETTERS[lang], k=rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n, lang="en"):
    return " ".join(words(rng, n, lang)) + "."


@pytest.fixture(scope="session")
def awkward():
    """Texts that operators must survive: null, empty, blank, one word, long, odd signs."""
    return [None, "", " \n\t ", "a", "A.", "x" * 300_000, "日本語 テキスト", "é ́ \x00 \x1c 🙂", "ab " * 40_000, "ab " * 40_000]


@pytest.fixture
def rng():
    return random.Random(7)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, component_id long"


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns whose names clash with results."""

    def make(texts, langs=None):
        rows = [(i, t, (langs or [None] * len(texts))[i], None, len(t or ""), 0.5, 1, -1) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
