"""Queries that aren't among the rows, several query blocks, ties, repeated rows, empty tables and other columns."""

import numpy as np
import pytest

from loomfield.llm import topk


def test_queries_that_are_no_candidates(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(200)]
    queries = [(1000 + i, [100.0 + i, 50.0]) for i in range(20)]  # alike: their scores are above all candidates'
    r, q = (spark.createDataFrame(x, "id long, vector array<double>") for x in (rows, queries))
    got = {}
    for x in topk.top_k(r, q, 3).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    want = {i: [(-s, k) for s, k in sorted((-int(v[0] * w[0] + v[1] * w[1]), k) for k, w in rows)[:3]] for i, v in queries}
    assert got == want


def test_ties_repeated_rows_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rows = [(i % 60, [float(i % 4), 2.0], "mine", 5) for i in range(120)] + [(None, [9.0, 9.0], "mine", 5), (70, None, "mine", 5), (71, [], "mine", 5)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, rank string, score long").repartition(3)
    got = {}
    for x in topk.top_k(df, df.where("id % 2 = 0"), 4, among=True).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    have = [(i, v) for i, v, *_ in rows if i is not None and v is not None]
    for q, v in {i: v for i, v in have if i % 2 == 0}.items():
        want = sorted((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in have if i != q)[:4]
        assert got[q] == [(-s, i) for s, i in want]


@pytest.mark.parametrize("some", [(True, False), (False, True), (False, False)])
def test_empty_tables(spark, some):
    df = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    rows, queries = (df if s else df.where("id < 0") for s in some)
    assert topk.top_k(rows, queries).collect() == []
    assert topk.top_k(rows, queries).columns == ["query_id", "rank", "vec_id", "score"]


def test_query_ids_with_several_vectors(spark):
    """Each candidate row once, with its greatest score for any of the query's vectors; other columns may have any name."""
    kinds = "id long, vector array<double>, query_id string, score string, rank string"
    vec = lambda i, *v: (i, [float(x) for x in v], "mine", "mine", "mine")
    rows = spark.createDataFrame([vec(1, 5, 0), vec(2, 4, 1), vec(2, 4, 1), vec(3, 0, 7), vec(0, 100, 100), vec(None, 9, 9)], kinds).repartition(3)
    queries = spark.createDataFrame([vec(0, 10, 0), vec(0, 9, 0), vec(0, 0, 10), vec(0, 10, 0), vec(8, 0, 1)], kinds)
    got = sorted(map(tuple, topk.top_k(rows, queries, 3).collect()))
    assert got == [(0, 1, 3, 70), (0, 2, 1, 50), (0, 3, 2, 40), (8, 1, 0, 100), (8, 2, 3, 7), (8, 3, 2, 1)]
    every = sorted(map(tuple, topk.top_k(rows, queries, 9).collect()))
    assert every[:4] == [(0, 1, 3, 70), (0, 2, 1, 50), (0, 3, 2, 40), (0, 4, 2, 40)] and len(every) == 4 + 5


def test_several_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.integers(-9, 9, 4).astype(float).tolist()) for i in rng.integers(0, 150, 400)]
    queries = [(int(i), rng.integers(-9, 9, 4).astype(float).tolist()) for i in rng.integers(0, 12, 40)]
    best = {}
    for q in {i for i, _ in queries}:
        own = [v for i, v in queries if i == q]
        scored = sorted((-max(int(np.dot(v, w)) for v in own), i) for i, w in rows if i != q)[:6]
        best |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored)}
    made = [spark.createDataFrame(t, "id long, vector array<double>") for t in (rows, queries)]
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(made[0].repartition(3), made[1], 6).collect()} == best
