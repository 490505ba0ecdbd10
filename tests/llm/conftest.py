"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, odd columns."""

import random

import pytest


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """(doc_id, text, source, fp, kept, size): columns with names that operators use themselves."""
    long, base = prose(1, 20_000), prose(2, 300)
    near = base.split()
    near[7] = "changed"
    texts = [None, "", "   \n\t ", "One", "two words", long, base, base, " ".join(near), base[:900] + " " + prose(3, 200), "Ünïcode  ÉÉ\u00a0x " + prose(4, 80), "a" * 200_000, prose(5, 49), prose(6, 50), prose(6, 50)]
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", "x", "y", 1.5) for i, t in enumerate(texts)]
    rows += [(6, base, "s0", "x", "y", 1.5), (None, base, None, None, None, None), (None, None, "s1", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp string, kept string, size double")
