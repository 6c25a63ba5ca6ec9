import random

import pytest

WORDS = [a + b for a in ("er", "on", "th", "in", "es", "ou", "ver", "ti") for b in ("ing", "ion", "at", "el", "and", "or", "um", "is")]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + (rnd.choice(WORDS) if rnd.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, one very long one, copies, near copies, accents, repeated ids."""
    long = prose(1, 30_000)
    base = prose(2, 120)
    near = base.split()
    near[60] = "changed"
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, long), (5, base), (6, base), (7, " ".join(near)), (8, "Grüße aus Köln, naïve café ﬁ 日本語 " + prose(3, 40)), (9, prose(4, 4))]
    out += [(10 + i, prose(100 + i, 30 + 7 * (i % 9))) for i in range(60)]
    return [*out, (20, out[20][1]), (20, out[20][1]), (None, prose(7, 25))]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t) if t else 0, "extra") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
