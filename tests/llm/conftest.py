import random

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, size int, digest string, kept string, bands int, key string"
        full = [(i, t, "en", f"s{i % 3}" if i and i % 7 else None, None if t is None else len(t), 5, "r", 1, "d", "k", 2, "y") for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def words():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    return lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture
def awkward(words):
    """Nulls, empty, blank, very long and repeated texts, texts without a word, odd white space, a repeated row."""
    long_ = words(30_000)
    return [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, long_), (5, long_ + " "), (6, "a"), (7, "a b"), (8, "A\tB"), (9, "one\u00a0word \x1c two"), (10, "x" * 5000), (11, "###" * 20 + "\n" * 3), (11, "###" * 20 + "\n" * 3), (12, "<|endoftext|> it's \u03a3\u03c3 \U0001f642"), (13, words(80)), (14, words(80))]
