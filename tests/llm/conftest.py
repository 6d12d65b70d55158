"""Documents with everything that may be odd about them."""

import random

import pytest

EXTRA = "kept string, score string, n string, digest string, rid string, words string, spans string, items string, row string, key string"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu Nu Xi ömikron pi rho sigma tau 42".split()


def prose(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + r.choice(WORDS) * (r.random() < 0.5))
        out.append("\n" if r.random() < 0.08 else r.choice([" ", " ", "  ", ", "]))
    return "".join(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * 10) for i, t, s in rows], DOCS)


def odd_rows():
    base = prose(1, 120)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [(None, prose(2, 80), "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", "a"), (5, "one two", "b")]
    rows += [(6, base, "a"), (7, base, "a"), (8, near, "b"), (8, near, "b"), (9, prose(3, 60_000), "a"), (10, "ß" * 500, "c"), (11, "a" * 3000, None)]
    rows += [(20 + i, prose(100 + i, 60), "a") for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
