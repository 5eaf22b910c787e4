import random

import pytest

from samples import DOCS, LONG, prose, row


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a very long one, ties, repeated rows, null keys and sources, copies."""
    rng = random.Random(4)
    rows = [row(i, prose(rng, rng.randint(1, 120)), "abc"[i % 3]) for i in range(40)]
    rows += [row(40, None), row(41, ""), row(42, " \n\t\n "), row(43, LONG), row(44, "one"), row(45, "x" * 5000, None)]
    rows += [row(46, rows[3][1], "b"), row(47, rows[3][1], "b"), row(47, rows[3][1], "b")]  # copies and a repeated row
    rows += [row(48, rows[5][1] + "\n" + rows[6][1] + "\n\n" + rows[5][1].upper()), row(None, "no key at all"), row(None, None)]
    rows += [row(49, "naïve café — 日本語  x <|endoftext|> it's 12 o'clock  \n\n y"), row(50, "a\x00b\r\nc")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
