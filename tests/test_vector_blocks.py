"""Exact search by blocks."""

import numpy as np

from codelode.operators import vectors as V


def test_vectors_of_several_dimensions_meet_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(3 + k % 2).tolist()) for k in range(60)] + [(60, []), (61, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in V.exact_topk(df, df, 4, skip_same=True, block=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, x in rows[:60]:
        near = sorted((-round(float(np.dot(x, y)), 6), d) for d, y in rows[:60] if d != q and len(x) == len(y))
        assert [d for _, d in sorted(got.get(q, []))] == [d for s, d in near if s < 0][:4]


def test_reranking_within_groups_needs_no_list_of_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{k % 3}", k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(120)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")
    pairs = spark.createDataFrame([(a, b) for g, a, _ in rows for h, b, _ in rows if g == h and a != b], "query_id long, id long")
    as_rows = lambda x: sorted((r.query_id, r["rank"], r.id, r.score + 0.0) for r in x.collect())
    assert as_rows(V.rerank_within(df, 7, block=16)) == as_rows(V.rerank(pairs, df, df, 7))
