import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blotter.llm import bpe
from blotter.llm.queries import tokenizer_file
from samples import LONG
from tables import table

FILE = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def merges():
    return bpe.encoder(FILE).merges


def test_pairs_agree_with_the_library(library, merges):
    """A pair of sound tokens is compatible exactly if the library's model gives it back."""
    rng = np.random.default_rng(0)
    sound = np.flatnonzero(merges.sound)
    letters = bpe.byte_letters()
    a, b = rng.choice(sound, 6000), rng.choice(sound, 6000)
    short = sound[merges.length[sound] <= 3]
    a, b = np.concatenate((a, rng.choice(short, 6000))), np.concatenate((b, rng.choice(short, 6000)))
    a, b = np.concatenate((a, short[:3000])), np.concatenate((b, short[:3000]))  # a token beside itself
    good = merges.compatible(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), good.tolist()):
        text = "".join(letters[c] for c in merges.bytes[x] + merges.bytes[y])
        assert g == ([t.id for t in library.model.tokenize(text)] == [x, y])
    assert 0 < good.sum() < len(good)


def test_exact_merging_agrees_with_the_library(library, merges):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdehinorst") for _ in range(rng.randint(1, 90))) for _ in range(600)] + [b"a" * 3001, b"ab" * 900]
    letters = bpe.byte_letters()
    want = [[t.id for t in library.model.tokenize("".join(letters[c] for c in w))] for w in words]
    assert merges.merge_all(words) == want
    assert [merges.merge(w) for w in words] == want
    assert merges.words(words) == want


def texts():
    rng = random.Random(2)
    out = ["", None, " ", "a" * 5000, LONG, "x" * 70_000, " a<|endoftext|>b <|endoftext|><|endoftext|> ", "<|endoftext|>", "<|endoftext",
           "naïve café — 日本語　x it's 12 o'clock  \n\n y", "a\x00b\r\nc", "\U0001F600" * 50 + "\x85 \x85", "  " * 300, "=-" * 999]
    out += ["".join(rng.choice("abcdet ehinorsTHE'.,\n\n  012éü日") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(200))
            for _ in range(60)]
    return out


def test_rows_equal_the_library(spark, library):
    rows = [(i if i % 9 else None, i, t, "ids", 0) for i, t in enumerate(texts())]
    rows += rows[5:8]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, place long, text string, ids string, n_tokens int")
    got = bpe.decode(bpe.encode(df, FILE), FILE).collect()
    assert len(got) == len(rows)
    by_place = {r[1]: r for r in rows}
    for r in got:
        text = by_place[r.place][2] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.text == library.decode(want, skip_special_tokens=False) == text
        assert r.doc_id == by_place[r.place][0]


def test_decode_of_any_ids(spark, library):
    rng = random.Random(3)
    ids = [[rng.randrange(50_257) for _ in range(rng.randint(0, 60))] for _ in range(300)] + [[50_256, 220], []]
    df = spark.createDataFrame([(i, np.array(x, "<u4").tobytes(), "old") for i, x in enumerate(ids)], "doc_id long, ids binary, text string")
    for r in bpe.decode(df, FILE).collect():
        assert r.text == library.decode(ids[r.doc_id], skip_special_tokens=False)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), FILE).first().text == ""


def test_whole_table_and_empty_table(spark, library):
    docs = table(spark, "documents")
    got = {r.doc_id: r for r in bpe.encode(docs, FILE).select("doc_id", "n_tokens", F.col("ids")).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.decode(bpe.encode(docs.limit(0), FILE), FILE).count() == 0
