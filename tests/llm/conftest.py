import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key int, n string, h long, a int, class string, id string, label double, pos int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.2) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) as a table with further columns whose names clash with internal ones."""

    def make(pairs):
        rows = [(i, t, "en", "src0", None, "x", 1, "y", 2, 3, "z", "w", 0.5, 7) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def messy(frame):
    """Nulls, empty and very long texts, ties, repeated rows, and clashing column names."""
    long_text = prose(1, 30_000)
    pairs = [(1, prose(2, 80)), (2, prose(2, 80)), (3, None), (4, ""), (5, " \n\t "), (6, long_text), (7, long_text + " more"), (8, "one")]
    pairs += [(9, prose(3, 60) + "\nshared line of text\n" + prose(4, 60)), (10, "SHARED line of text  \nshort\n\n")]
    pairs += [(1, prose(2, 80)), (None, prose(5, 70)), (None, None), (11, "été ▁ 漢字 😀 \x00 <s> naïve ² 3.5 km")]
    return frame(pairs)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
