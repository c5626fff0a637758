from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, lang[, source]]) rows."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:] + (None,) * (4 - len(r)))) for r in map(tuple, rows)]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCUMENTS)

    return make


@pytest.fixture
def prose():
    """Invented prose of a seeded generator: words of a language's own syllables."""
    import random

    syllables = {"aa": "ba be bi bo bu da de di do du".split(), "bb": "kra kre kri kro kru spa spe spi spo spu".split()}

    def write(seed, n=60, lang="aa"):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))

    return write
