import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, lang[, source]]) as documents."""

    def build(rows, schema=SCHEMA):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, repeated rows, ties, astral characters, a long text."""
    rng = random.Random(5)
    words = ["the", "Cat", "naïve", "x1", "日本", "😀", "end.", "a@b.co", "über", "t\u0085t"]
    long = " ".join(rng.choice(words) + str(i % 7) for i in range(6000))
    same = " ".join(rng.choice(words) for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, same, None, None), (5, same), (5, same), (6, same.replace(" ", "\n") + " "), (7, long), (8, long + " tail"), (9, "one"), (10, "one two"), (None, "no id at all here"), (11, same + " and a little more"), (12, "é" * 120), (13, "é" * 121)]
    rows += [(20 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def clashing():
    """Names of columns that the operators use themselves."""
    return ["row", "size", "score", "lang_pred", "node", "digest", "sha", "tk", "salt", "kept", "taken", "h", "_id", "bit", "label", "words", "n"]
