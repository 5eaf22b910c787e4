import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from blotter.llm import line_dedup, minmax_dedup  # noqa: E402
from blotter.llm.store import stage, table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, step in pipeline.STAGES:
        out.append((docs, docs := stage(step(spark, docs, SF), f"test-{name}")))
    return out


def test_stages_pass_documents_on(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixed", "packed"]
    assert all(sorted(after.columns) == sorted(columns) for _, after in stages[:-1])


def test_quality_rejects_junk_and_keeps_the_rest(spark, stages):
    before, after = stages[0]
    good = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert kept < {r.doc_id for r in before.collect()}
    assert sum(i in kept for i, q in good.items() if q) > 0.95 * sum(q for q in good.values())
    assert all(r.text == t for r, t in zip(after.orderBy("doc_id").collect(),
                                           [r.text for r in before.orderBy("doc_id").collect() if r.doc_id in kept]))


def test_lines_lose_only_repetitions(stages):
    before, after = stages[1]
    left = {r.doc_id: r.text for r in after.collect()}
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(before).collect()}
    assert all(want[i] == t for i, t in left.items())
    assert all(not t.split() for i, t in want.items() if i not in left)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2]
    groups = defaultdict(list)
    for r in minmax_dedup.near_duplicates(before).collect():
        groups[r.component_id].append(r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(groups)


def test_pieces_hold_the_mixture(stages):
    before, after = stages[4]
    tokens, have = defaultdict(int), defaultdict(int)
    for p in after.collect():
        have[p.doc_id] += p.length
        tokens[p.doc_id] = p.doc_tokens
    for r in before.groupBy("doc_id").count().collect():
        assert have[r.doc_id] == tokens[r.doc_id] * r["count"]


def test_near_copies_from_four_fifths_go(spark, odd):
    base = " ".join(f"w{i}" for i in range(100))
    more = base + "".join(f" x{i}" for i in range(20))  # 96 of 116 shingles: 0.83
    other = base + "".join(f" y{i}" for i in range(30))  # 96 of 126, and 96 of 146: too few
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate((base, more, other))], odd.schema)
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, df, SF).collect()) == [0, 2]


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_and_no_rows(spark, odd, none, k):
    name, step = pipeline.STAGES[k]
    assert step(spark, none, SF).count() == 0
    assert step(spark, odd, SF).count() > 0
