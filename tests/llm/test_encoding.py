import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from blotter.llm import encoding

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@lru_cache
def plain(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def encode(name, texts):
    ids, counts = encoding.encoder(P.path(name)).encode_rows(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("name", FILES)
def test_equals_the_tokenizer_on_odd_texts(name, odd_rows):
    rng = random.Random(1)
    texts = [r[1] for r in odd_rows] + ["".join(rng.choice("ab 's\n\t  é1!<|́Σ \u0085") for _ in range(rng.randint(0, 40)))
                                        for _ in range(1500)]
    assert encode(name, texts) == [plain(name).encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_equals_the_tokenizer_on_any_text(texts):
    for name in FILES:
        t = plain(name)
        assert encode(name, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_full_table_of_units_is_dropped(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_UNITS", 5)
    e = encoding.FastEncoder(P.path(FILES[0]))
    t = plain(FILES[0])
    for text in ("one two three four", "five six seven", "one nine ten eleven twelve"):
        assert e.encode_rows(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids
