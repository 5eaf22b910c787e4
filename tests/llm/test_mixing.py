import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from blotter.llm import ORACLES, mixing
from blotter.llm.queries import op8_splitting_tree

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def targets(sizes, weights, ceiling=3):
    """Share by weight; hold what is above its ceiling and share the rest again."""
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in held]
        rate = (total - sum(ceiling * sizes[s] for s in held)) / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if rate * weights[s] > ceiling * sizes[s]}
        if not over:
            return {s: ceiling * sizes[s] if s in held else rate * weights[s] for s in sizes}
        held |= over


def mixed(df, **kw):
    return mixing.mix(df, mixing.repeating_weights(df, "source"), mixing.word_count(F.col("text")), **kw)


def test_targets_and_limits(odd, odd_rows):
    rows = mixed(odd).collect()
    assert len(rows) == len(odd_rows)
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall((r[1] or "").encode()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets(sizes, {s: float(i % 3 + 1) for i, s in enumerate(order)})
    taken = Counter()
    for r in rows:
        assert r.size == len(WORD.findall((r.text or "").encode())) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken == r.size * len(r.places) <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    again = mixed(odd.repartition(3)).select("doc_id", "taken", "places").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixed(odd).select("doc_id", "taken", "places").collect())


def test_rows_and_clashing_names(odd, none):
    df = odd.withColumn("target", F.lit("t")).withColumn("block", F.lit("b")).withColumn("pass", F.lit("p"))
    out = mixed(df)
    assert [c for c in out.columns if c in ("block", "pass")] == ["block", "pass"] and out.schema["target"].dataType.simpleString() == "double"
    copies = mixing.mixture(out).collect()
    assert Counter(r.doc_id for r in copies) == Counter(
        {k: v for k, v in sum((Counter({r.doc_id: len(r.places)}) for r in out.collect()), Counter()).items() if v})
    assert mixed(none).count() == 0


def test_shards_get_disjoint_and_even_parts(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"),
                                  F.lit("one two").alias("text"))
    rows = mixing.mixture(mixed(df, shards=6)).collect()
    held = defaultdict(Counter)
    for r in rows:
        held[r.shard][r.source] += 1
    assert sorted(held) == list(range(6))
    totals = [sum(c.values()) for c in held.values()]
    assert max(totals) < 1.25 * min(totals)


def test_rows_are_dealt_by_shard_and_not_as_the_input_lies(spark):
    df = spark.range(0, 6000, 1, 6).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / 2000).cast("string")).alias("source"), F.lit("one two").alias("text"))
    tasks, shards = defaultdict(list), defaultdict(set)
    for r in mixing.mixture(mixed(df), parts=2).withColumn("task", F.spark_partition_id()).collect():
        tasks[r.task].append(r.source)
        shards[r.shard].add(r.task)
    assert len(tasks) == 16 and all(len(t) == 2 for t in shards.values()) and len(set.union(*shards.values())) == 16
    for own in tasks.values():
        count = Counter(own)
        runs = 1 + sum(a != b for a, b in zip(own, own[1:]))
        # As many changes of source as a random order has, not a run for each source.
        assert len(count) == 3 and runs > 0.7 * len(own) * (1 - sum((c / len(own)) ** 2 for c in count.values()))


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(ORACLES["op8_splitting_tree"])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(r) for r in cur.fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in op8_splitting_tree(spark, sf).collect())
    assert got == want


def test_no_python_in_the_plan(odd):
    plan = mixing.mixture(mixed(odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
