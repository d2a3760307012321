import random

import pytest


@pytest.fixture(scope="session")
def hard_rows():
    """Texts with nulls, empties, ties, copies, odd white space, long words and other scripts."""
    rng = random.Random(7)
    words = ["the", "of", "Thand", "einer.", "ção", "x", "ǅungla", "12", "don't", "$5%", "Σας", "a" * 300]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "   \n\t", "one", "one two", "one two three", " nbsp joined words here", "a\x0bb\x0cc\rd", "und " * 400, "x" * 5000, passage, "before it " + passage, passage + " after it", prose[0], prose[0], prose[1] + " changed", "line\nline\nother\n\nline", "emoji 👍🏽 and ﬁ ligature é accents"]
    texts += prose
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    return spark.createDataFrame(hard_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
