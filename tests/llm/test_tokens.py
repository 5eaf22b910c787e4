import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from blotter.llm import packing, token_store
from blotter.session import shared_path


def ids_of(name, texts, end):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return [np.array(e.ids + [end], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_store_round_trip(spark, odd, odd_rows):
    path = shared_path(spark, "test-store")
    token_store.write_store(odd, path, P.path("byte_bpe_50k.json"), 0, 50_257, partitions=3)
    got = token_store.read_store(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", token_store.crc_rows).collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for r, ids in zip(rows, ids_of("byte_bpe_50k.json", [r[1] for r in rows], 0)):
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    some = token_store.read_document(spark, path, 49)
    assert [x.tolist() for x in some] == [ids_of("byte_bpe_50k.json", [r[1] for r in odd_rows if r[0] == 49], 0)[0].tolist()]
    assert len(token_store.read_document(spark, path, 47)) == 2 and not token_store.read_document(spark, path, 999)


def test_store_of_nothing_and_a_wrong_dictionary(spark, none):
    path = shared_path(spark, "test-store")
    token_store.write_store(none, path, P.path("byte_bpe_50k.json"), 0, 50_257)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    assert token_store.read_store(spark, path, schema, token_store.crc_rows).count() == 0
    broken = shared_path(spark, "test-store")
    spark.createDataFrame([("0" * 32, bytearray(b"x"))], "dict_hash string, dictionary binary").write.parquet(f"{broken}/dictionary")
    with pytest.raises(ValueError):
        token_store.read_store(spark, broken, schema, token_store.crc_rows)


def test_pieces_cover_documents_and_sequences(spark, odd, odd_rows):
    pieces = packing.pack(odd.repartition(3), P.path("word_bpe_49k.json"), 2, capacity=256).collect()
    ids = defaultdict(list)
    for r, x in zip(odd_rows, ids_of("word_bpe_49k.json", [r[1] for r in odd_rows], 2)):
        ids[r[0]].append(x.tobytes())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for key, want in ids.items():
        if len(want) == 1:
            got = sorted(by_doc[key], key=lambda p: p.start)
            assert b"".join(p.ids for p in got) == want[0]
            assert [p.start for p in got] == list(np.cumsum([0] + [p.length for p in got])[:-1])
            assert {p.doc_tokens for p in got} == {len(want[0]) // 4}
        assert sum(p.length for p in by_doc[key]) == sum(map(len, want)) // 4
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert sum(p.length for p in own) <= 256


def test_cuts_are_class_sizes():
    sizes = packing.class_sizes(4096)
    for n in [*range(1, 9000, 7), 4096, 2048, 4095, 4097]:
        parts = packing.cut(n, sizes)
        assert sum(parts) == n and all(p in sizes for p in parts[:-1])
        assert all(packing.class_of(p, sizes) >= p for p in parts)
        assert len(parts) <= n // 4096 + 8


def test_rest_is_placed_without_overlap():
    lengths = [(i * 37) % 90 + 1 for i in range(500)]
    place = packing.pack_rest(lengths, 256, packing.class_sizes(256))
    held = defaultdict(list)
    for n, (s, o) in zip(lengths, place):
        held[s].append((o, n))
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert own[-1][0] + own[-1][1] <= 256


def test_nothing_to_pack(none):
    assert packing.pack(none, P.path("word_bpe_49k.json"), 2).count() == 0


def test_samples_come_from_all_of_long_texts(spark):
    text = " ".join(f"{i:06d}" for i in range(10_000))
    docs = spark.createDataFrame([(k, text if k else None) for k in range(60)], "key long, text string")
    texts = [r.text for r in token_store.sample_texts(docs).collect() if r.text]
    places = [text.index(t) for t in texts]
    assert len(texts) == 59 and {len(t) for t in texts} == {token_store.SAMPLE_CHARS}
    assert min(places) < 10_000 and max(places) > 50_000 and len(set(places)) > 50
