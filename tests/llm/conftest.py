import random

import pytest

LONG = " ".join(random.Random(1).choice(["alpha", "beta", "Gamma,", "x=1", "déjà", "42"]) for _ in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long and repeated texts, a missing id, and columns whose names operators use themselves."""
    rows = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, "  \n\t "), (None, "no id here at all"), (5, LONG), (6, "tie tie"), (7, "tie tie")]
    names = "ids decoded spans score group shard slot word node cid part tokens item_id n_words kept target n"
    return spark.createDataFrame([(i, t, *[str(i)] * len(names.split())) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names.split()))


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    syllables = ["ta", "re", "mi", "on", "el", "ish", "dor", "ka", "ve", "lum"]
    names = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(800)]
    return lambda n: " ".join(rng.choice(names) for _ in range(n))
