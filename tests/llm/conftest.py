import random

import pytest


def prose(seed, words, vocabulary=400):
    """Words of a small invented language."""
    r = random.Random(seed)
    pool = ["".join(r.choice("aeioustrnlmdké") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(pool) for _ in range(words))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, huge, repeated and strange texts."""
    base = prose(1, 300)
    return [None, "", " \n\t ", "a", "word " * 3, "a" * 30_000, base, base, base + " more", prose(2, 5_000),
            "Ä ö\x00\x1c\x85　 \U0001f600 <|endoftext|> x", "x\r\ny\n\n\nx\n" * 40, base.replace("a", "b", 2), None, ""]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The strange texts with a repeated row, a null key and columns of clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s", i, 7, "x", 1.5) for i, t in enumerate(odd_texts)]
    rows += [rows[6], (None, "no key", None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string, _row double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
