import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blotter.llm import ann_scan, topk_pivot

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v], 0, "s", 1) for i, v in enumerate(rng.standard_normal((600, 16)).astype(np.float32))]
    rows += [(600 + i, rows[7][1], 0, "s", 1) for i in range(30)]  # ties
    rows += [(650, None, 0, "s", 1), (651, [0.0] * 16, 0, "s", 1), (652, [math.nan] + [1.0] * 15, 0, "s", 1), (700, [None] + [1.0] * 15, 0, "s", 1),
             (653, [math.inf] * 16, 0, "s", 1), (654, [], 0, "s", 1), (655, [1.0, 2.0], 0, "s", 1), (None, rows[0][1], 0, "s", 1),
             (3, rows[3][1], 0, "s", 1)]  # a repeated row
    return rows, spark.createDataFrame(rows, SCHEMA)


def fine(rows, zero):
    return [(r[0], np.array(r[1], dtype=np.float64)) for r in rows
            if r[0] is not None and r[1] and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1])
            and (zero or any(r[1]))]


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r["score"]))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_exact_top_k(vectors):
    rows, df = vectors
    good = [(i, np.floor(256 * v).astype(np.int64)) for i, v in fine(rows, True)]
    asked = sorted({i for i, _ in good if i % 50 == 0})
    got = answers(topk_pivot.search(df, df.where("vec_id % 50 = 0")))
    assert sorted(got) == asked
    for q in asked:
        v = next(v for i, v in good if i == q)
        want = sorted(((i, int(v @ x)) for i, x in good if i != q), key=lambda t: (-t[1], t[0]))[:5]
        assert got[q] == want


def test_pivots_leave_candidates_out():
    rng = np.random.default_rng(1)
    centre = rng.integers(-900, 900, (40, 8))
    rows = (np.repeat(centre, 50, axis=0) + rng.integers(-9, 9, (2000, 8))).astype(np.int64)
    most = float((rows * rows).sum(axis=1).max())
    lift = np.concatenate((rows, np.sqrt(most - (rows * rows).sum(axis=1))[:, None]), axis=1)
    pivots = lift[::40]
    table = np.sqrt(((lift[:, None] - pivots) ** 2).sum(axis=2))
    q = rows[777]
    point = np.append(q.astype(float), 0.0)
    ids = np.arange(2000)
    hits, scores, tried = topk_pivot.search_block(
        q, 777, np.sqrt(((pivots - point) ** 2).sum(axis=1)), ids, rows, table, float(point @ point) + most, 5, None)
    product = rows @ q
    product[777] = -(10 ** 12)
    assert hits.tolist() == np.lexsort((ids, -product))[:5].tolist()
    assert tried < 1500


def test_recall_and_scores(vectors):
    rows, df = vectors
    good = fine(rows, False)
    got = answers(ann_scan.search(df, df.where("vec_id % 10 = 0")))
    hit = total = 0
    for q, found in got.items():
        v = next(v for i, v in good if i == q)
        cos = sorted(((i, float(v @ x / math.sqrt((v @ v) * (x @ x)))) for i, x in good if i != q), key=lambda t: (-t[1], t[0]))
        by = dict(cos)
        assert all(abs(by[i] - s) < 1e-12 for i, s in found) and len(found) == 5
        hit += sum(s >= cos[4][1] - 1e-12 for _, s in found)
        total += 5
    assert sorted(got) == sorted({i for i, _ in good if i % 10 == 0})
    assert hit / total >= 0.9


def test_ties_go_to_smaller_keys_and_all_probes_are_exact(vectors):
    rows, df = vectors
    got = answers(ann_scan.search(df, df.where("vec_id IN (7, 600)"), probes=1.0))
    assert [i for i, _ in got[7]] == [600, 601, 602, 603, 604]
    assert [i for i, _ in got[600]] == [7, 601, 602, 603, 604]


@pytest.mark.parametrize("search", [ann_scan.search, topk_pivot.search])
def test_few_and_no_rows(vectors, search):
    _, df = vectors
    none = df.where(F.lit(False))
    assert search(none, none).count() == 0 and search(df, none).count() == 0
    few = df.where("vec_id IN (1, 2)")
    assert {r.vec_id for r in search(few, few.where("vec_id = 1")).collect()} == {2}
