import random

import pytest

#: Columns that operators make for themselves; a table may have them too.
CLASH = "text_key string, part string, n_shingles string, component_id string, score string, rank int, seed string, host string, k string, r string"
CLASHING = ("x", "x", "x", "x", "x", 1, "x", "x", "x", "x")


@pytest.fixture
def docs_of(spark):
    """documents(doc_id, text, lang, source, n_chars) with clashing columns, from (doc_id, text) pairs."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), *CLASHING) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n invented words."""

    def make(n, seed):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice(["ka", "lo", "mi", "ne", "tu", "ri", "so", "Pe", "vé"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture
def odd(prose):
    """Nulls, empty and blank texts, a long text, ties and repeated rows."""
    long = prose(30_000, 99)
    same = prose(80, 5)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, same), (6, same), (6, same), (None, same), (7, long), (8, "ö 漢字 🙂 \x01 x"), (9, "a " * 300)]
