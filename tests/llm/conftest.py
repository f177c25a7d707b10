import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
    return " ".join(words)


def make_rows(seed=3):
    """Small documents with copies, near copies, ties, nulls, blanks, odd characters and a very long text."""
    import random

    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bdkmst" for b in "aeiou" for c in ["n", "r", "lt", "é"]]
    prose = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 120))) for _ in range(60)]
    texts = prose + [near(rng, t, 1) for t in prose[:25]] + prose[:8] + [prose[0]] * 9
    texts += [None, "", "   ", "x", "a b c", "a b c d", "A B c  d", "don't  stop\n\n", "日本語の文", "tail ", " \n", "<|endoftext|> z", "e\u0301 İ"]
    texts += [" ".join(rng.choice(vocab) for _ in range(30000)), "q" * 50000]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src7", "src12", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, "no id here at all", "en", "src0", 17), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
