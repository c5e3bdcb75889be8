import string

import pytest

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="session")
def lower():
    return lambda t: (t or "").translate(LOWER)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns that clash with operators' own names."""

    def make(pairs):
        rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, "x") for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, kept string")

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    def make(r, n):
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make
