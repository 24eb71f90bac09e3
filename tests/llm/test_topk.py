"""Exact top-k search: against SQL, and against all pairs on awkward rows and many units."""

import random

import pytest
from pyspark.sql import functions as F

from provena.llm import registered, topk_search

ROWS = "id long, terms array<int>, weights array<long>, key string, tile int"


def brute_force(rows, every, k):
    live = [(i, dict_of(t, w), (tuple(t), tuple(w))) for i, t, w, *_ in rows if t is not None and w is not None]
    out = []
    for i, key in sorted({(i, v) for i, _, v in live if i is not None and i % every == 0}):
        q = dict_of(*key)
        scored = sorted((-sum(w * v.get(t, 0) for t, w in q.items()), j is None, j or 0) for j, v, _ in live if j != i)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(map(str, out))


def dict_of(terms, weights):
    d = {}
    for t, w in zip(terms, weights):
        d[t] = d.get(t, 0) + w
    return d


def searched(spark, rows, every, k, **sizes):
    got = topk_search.top_k(spark.createDataFrame(rows, ROWS), F.col("id") % every == 0, k, **sizes)
    assert got.columns == ["query_id", "rank", "id", "score"]
    return sorted(str(tuple(r)) for r in got.collect())


def test_same_as_sql(spark, sf, same_rows):
    same_rows(registered.QUERIES["op13_topk_search"](spark, sf), registered.ORACLES["op13_topk_search"])


@pytest.mark.parametrize("tile,group", [(4_000_000, 1_000_000), (40, 1_000_000), (100, 30), (4_000_000, 7)])
def test_units_of_any_size(spark, tile, group):
    """Few different scores, so ties decide; a third of the rows are one vector; common and rare terms."""
    draw = random.Random(tile + group)
    rows = []
    for i in range(150):
        terms = draw.sample(range(12), draw.randint(0, 5)) + ([99] if draw.random() < 0.7 else [])
        rows.append((i, terms, [draw.randint(-2, 2) for _ in terms], "clash", 1) if i % 3 else (i, [1, 2], [1, 1], "clash", 1))
    assert searched(spark, rows, 10, 6, tile=tile, group=group) == brute_force(rows, 10, 6)


def test_awkward_rows(spark):
    rows = [(0, [1, 2], [3, -1], "", 0), (None, [1], [2], "", 0), (None, [], [], "", 0), (4, None, None, "", 0), (5, [2, 1, 2], [1, 1, 1], "", 0), (5, [2, 1, 2], [1, 1, 1], "", 0), (10, [], [], "", 0)]
    rows += [(10, [1], [1], "", 0), (10, [1], [1], "", 0), (-20, [7], [10**6], "", 0), (21, list(range(5000)), [1] * 5000, "", 0)]
    assert searched(spark, rows, 10, 4) == brute_force(rows, 10, 4)
    assert searched(spark, rows, 10, 100) == brute_force(rows, 10, 100)  # fewer rows than k
    assert searched(spark, [], 10, 4) == [] == searched(spark, rows[1:5], 10, 4)


def test_blocks_within_a_group(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, [draw.randint(0, 3), 4], [draw.randint(-3, 3), 1], "", 0) for i in range(9000)]
    assert searched(spark, rows, 3000, 20) == brute_force(rows, 3000, 20)


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(Exception, match="64 bits"):
        searched(spark, [(0, [1], [1 << 40], "", 0), (1, [1], [1 << 40], "", 0)], 10, 4)


def test_vectors_that_take_no_part(spark):
    e = [(1, [0.5, -0.01, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("-inf"), 1.0]), (6, [])]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(e, "i int, e array<float>").select("i", topk_search.sparse(F.col("e"), 64).alias("v")).collect()}
    assert got[1].terms == [0, 1] and got[1].weights == [32, -1] and got[6].terms == []
    assert all(got[i] is None for i in (2, 3, 4, 5))


def test_plan_has_no_cross_join(spark, sf):
    plan = registered.QUERIES["op13_topk_search"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan and "Broadcast" not in plan
