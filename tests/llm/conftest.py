import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """A documents table of texts, with columns whose names clash with inner ones."""

    def make(rows, **extra):
        full = [(r if isinstance(r, tuple) else (k, r)) for k, r in enumerate(rows)]
        table = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y", 1) for r in full]
        return spark.createDataFrame(table, DOCS + ", fp string, words string, score int").repartition(3)

    return make


@pytest.fixture
def prose():
    """Random sentences; the same seed gives the same words."""

    def make(seed, words=80, letters="abcdefghijklmnop"):
        r = random.Random(seed)
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(words))

    return make
