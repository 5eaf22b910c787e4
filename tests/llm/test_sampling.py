import public_tokenizers as P
from pyspark.sql import functions as F

from blotter.llm import packing, sampling, token_store
from blotter.session import shared_path


def picked(keys, n):
    return [r.key for r in sampling.sample_keys(keys, n).orderBy("hash").collect()]


def test_the_smallest_hashes_are_picked(spark):
    keys = spark.range(200_000).select(F.col("id").alias("key"))
    want = [r.key for r in keys.orderBy(F.xxhash64("key")).limit(400).collect()]
    assert picked(keys, 400) == want
    hot = keys.unionAll(spark.range(100_000).select(F.lit(7).cast("long").alias("key"))).unionAll(keys.where("key < 9"))
    assert picked(hot, 400) == want


def test_few_distinct_keys_are_all_picked(spark):
    keys = spark.range(50_000).select((F.col("id") % 11).alias("key")).unionAll(spark.sql("SELECT CAST(NULL AS long) AS key"))
    assert set(picked(keys, 400)) == {*range(11), None}
    assert len(picked(keys, 5)) == 5 and picked(keys.limit(0), 5) == []


def test_one_value_a_key(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, None)], "key long, text string")
    got = sampling.sampled(rows, sampling.sample_keys(rows.select("key"), 10), F.col("text")).collect()
    assert sorted(str(r.value) for r in got) == ["None", "a", "n"]


def clashing(odd):
    names = ("key", "hash", "part", "block", "value", "start", "length", "ids", "sequence_id", "offset", "doc_tokens")
    return odd.withColumns({c: F.lit("mine") for c in names})


def test_store_with_clashing_names(spark, odd):
    schema, rows = "doc_id long, start long, n_tokens long, ids_crc32 long", []
    for df in (odd, clashing(odd)):
        path = shared_path(spark, "test-store")
        token_store.write_store(df, path, P.path("byte_bpe_50k.json"), 0, 50_257, partitions=2)
        rows.append(sorted(map(str, token_store.read_store(spark, path, schema, token_store.crc_rows).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == odd.count()


def test_packing_with_clashing_names(odd):
    tokens = [packing.pack(df, P.path("word_bpe_49k.json"), end_id=2).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
              for df in (odd, clashing(odd))]
    assert sorted(map(str, tokens[0])) == sorted(map(str, tokens[1]))
