import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, h string, words string, t1 string, slot int, block int, shard string, _file string, stratum int, n_words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été ñandú".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward_texts() -> list[tuple]:
    """Rows with nulls, blanks, ties, copies, near copies and a long text."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), None, "b"), (4, None, "en", "a"), (5, "", "fr", None), (6, " \n\t ", None, "b"),
        (7, prose(2, 3000), "fr", "a"), (8, "two words", "en", "b"), (9, "two words", "en", "b"), (None, prose(3, 80), "en", "a"), (None, None, None, None),
        (10, prose(4, 60) + " " + prose(5, 60), "en", "a"), (11, prose(6, 40) + " " + prose(5, 60), "fr", "a"), (12, prose(7, 100), "en", "c"), (12, prose(7, 100), "en", "c"),
        (13, "12345 !!! 678", "en", "a"), (14, "\n".join([prose(8, 9)] * 12), "en", "a"), (15, "ÀÉ É é é \U0001f600 " + prose(9, 30), "fr", "b"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, None, 1, "h", "w", "t", 3, 4, "s", "f", 5, "n") for r in awkward_texts()], SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
