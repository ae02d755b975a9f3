import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text) or (doc_id, text, source)."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture
def words():
    """Seeded sentences of made-up words."""
    draw = random.Random(5)
    syllables = "ba ce di fo gu ha je ki lo mu na pe ri so tu".split()
    return lambda n: " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n))
