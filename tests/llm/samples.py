"""Hand-made documents for the operators' tests."""

from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet " * 9000

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def row(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text))


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(n))


def prose_rows(rng, first, n, lines=False):
    out, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.5:
            text = rng.choice(bases).split(" ")
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = prose(rng, 1)
            text = " ".join(text)
        else:
            text = prose(rng, rng.randint(60, 150))
            if lines:
                text = "\n".join(prose(rng, rng.randint(3, 80)) for _ in range(4))
            bases.append(text)
        out.append(row(first + i, text))
    return out
