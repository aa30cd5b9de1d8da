import random

import pytest

LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and columns
    whose names an operator might use itself."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    body = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    near = body[0].split()
    near[30] = "edited"
    rows = [
        (1, body[0], "en", "a"), (2, body[0], "en", "b"), (3, " ".join(near), "en", None), (4, None, "en", "a"), (5, "", None, "a"), (6, " \n\t ", "de", "b"),
        (7, LONG, "en", "a"), (8, body[1], None, None), (8, body[1], None, None), (9, body[2], "fr", "a"), (9, body[3], "fr", "b"), (None, body[4], "en", "c"),
        (None, None, None, None), (10, "ONE two three", "en", "c"), (11, "one TWO three", "en", "c"), (12, f"{body[5]}\n{body[1]}\nshort line", "en", "c"), (13, "ünï cödé ßtraße   x", "de", "ü"),
    ]
    extra = [(*r, len(r[1] or ""), k, f"n{k}", None) for k, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, size int, rank string, tokens array<int>")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
