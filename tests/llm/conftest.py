"""Small documents with the cases that every operator has to stand."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string"


@pytest.fixture(scope="session")
def prose():
    def make(n, words=60, seed=1, letters="abcdefgh"):
        rnd = random.Random(seed)
        lexicon = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(400)]
        return [" ".join(rnd.choice(lexicon) for _ in range(words)) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """Rows to a table with extra columns whose names clash with inner ones."""

    def make(texts, lang="en"):
        rows = [(i, t, lang if isinstance(lang, str) else lang[i], "s", len(t) if t is not None else None, "x", "y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs, prose):
    """Null, empty, blank, very long, repeated and ordinary texts."""
    long = " ".join(prose(40, 600, seed=9))
    return docs([None, "", " \n\t ", long, "same text here", "same text here", "ß ñandú 中文 \U0001f600 \u0000 x", *prose(5)])
