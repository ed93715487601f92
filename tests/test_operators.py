"""Invariants and brute force for what has no SQL."""

import math

import numpy as np
from pyspark.sql import functions as F

from codelode.operators import assemble, graph, lexical
from codelode.operators import vectors as V


def modularity(edges, of):
    m, degree = len(edges), {}
    for a, b in edges:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    inside = sum(of[a] == of[b] for a, b in edges) / m
    mass = {}
    for n, d in degree.items():
        mass[of[n]] = mass.get(of[n], 0) + d
    return inside - sum((x / (2 * m)) ** 2 for x in mass.values())


def test_communities_find_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(5) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]
    got = {r.node: r.module for r in graph.communities(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert {frozenset(n for n in got if got[n] == m) for m in set(got.values())} == {frozenset(f"{g}{i}" for i in range(5)) for g in "abc"}
    assert modularity(edges, got) > modularity(edges, {n: 0 for n in got})


def test_pagerank_adds_up(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "x")], "source string, target string")
    assert abs(sum(r["rank"] for r in graph.pagerank(e).collect()) - 1) < 1e-9


def test_rotation_is_orthogonal_and_keeps_neighbours(spark):
    q = V.rotation(16)
    assert np.allclose(q @ q.T, np.eye(16))
    rng = np.random.default_rng(0)
    rows = [(k, (x / np.linalg.norm(x)).tolist()) for k, x in enumerate(rng.standard_normal((200, 16)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    exact = {(r.query_id, r.id) for r in V.exact_topk(df, df, 5, skip_same=True).collect()}
    turned = {(r.query_id, r.id) for r in V.quantized_topk(df, df, 5, turn=(16, 42), skip_same=True).collect()}
    assert len(exact & turned) > 0.75 * len(exact)


def test_exact_topk_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (90, 4)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in V.exact_topk(df, df, 7, skip_same=True, block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    s = x @ x.T
    for q in range(90):
        best = sorted((-s[q, d], d) for d in range(90) if d != q and s[q, d] > 0)[:7]
        assert [d for _, d in sorted(got.get(q, []))] == [d for _, d in best]


def naive_stages(contrib, n, enough, k):
    """The staged loop over word subsets of one question, contrib: chunk -> {word number: contribution}."""
    from itertools import combinations

    def run(words):
        return {c: sum(x[w] for w in words) for c, x in contrib.items() if all(w in x for w in words)}

    if n > 1:
        full = run(range(n))
        if len(full) >= enough:
            return 1, full
    best = {}
    for stage, size, least in ((2, n - 1, 3), (3, 2, 4)):
        if n >= least:
            for words in combinations(range(n), size):
                for c, s in run(words).items():
                    best[c] = max(best.get(c, -math.inf), s)
            if len(best) >= enough:
                return stage, best
    return 4, {c: sum(x.values()) for c, x in contrib.items()}


def test_graduated_against_the_staged_loop(spark):
    import random

    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    chunks = [(k, " ".join(rng.choice(words + ["x"] * 6) for _ in range(8)), f"p{k}.py") for k in range(150)]
    df = spark.createDataFrame(chunks, "chunk_id long, content string, file_path string")
    questions = [(n, " ".join(words[:n])) for n in range(1, 6)]
    q = spark.createDataFrame(questions, "query_id long, question string")
    c = {}
    for r in lexical.contributions(df, q, ["content", "file_path"]).collect():
        c.setdefault(r.query_id, {}).setdefault(r.chunk_id, {})[r.pos] = r.c
    for enough in (1, 10, 40):
        got = {}
        for r in lexical.graduated(df, q, ["content", "file_path"], 1000, enough=enough).collect():
            got.setdefault(r.query_id, {})[r.chunk_id] = (r.stage, r.score)
        for n, _ in questions:
            stage, want = naive_stages(c[n], n, enough, 1000)
            assert {x: (stage, round(s, 6)) for x, s in want.items()} == got[n]


def test_budgets(spark):
    df = spark.createDataFrame([(t,) for t in (1000, 10000, 16384, 30000)], "t long")
    b = F.lit(8192).cast("long")
    got = [tuple(r) for r in df.select(assemble.dynamic_budget(F.col("t"), b), assemble.capped_budget(F.col("t"), b)).collect()]
    assert got == [(1000, 1000), (9800, 8192), (12288, 8192), (8192, 8192)]


def test_greedy_pack_skips_and_stops(spark):
    r = spark.createDataFrame([(1, 10, 10.0, 5), (1, 11, 9.0, 6), (1, 12, 8.0, 4), (1, 13, 2.0, 1)], "query_id long, chunk_id long, final double, token_count long")
    b = spark.createDataFrame([(1, 10)], "query_id long, budget long")
    assert [x.chunk_id for x in assemble.greedy_pack(r, b).orderBy("place").collect()] == [10, 12]


def test_six_decimals_as_in_sql(spark, tmp_path):
    import duckdb

    from codelode.plans import relations as R

    xs = [-1e-8, 1e-8, -0.0, 0.0, 0.1234565, -0.1234565, 2.5e-6, -2.5e-6, 0.07532, 1.0000005, -3.25]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(R.to_six(F.col("x"))).collect()
    want = duckdb.connect().sql("select round(x, 6) from (values " + ", ".join(f"({k}, {x!r}::double)" for k, x in enumerate(xs)) + ") t(k, x) order by k").fetchall()
    assert [repr(r[0]) for r in got] == [repr(r[0]) for r in want]


def test_phrases_that_follow_directly_are_found_as_in_sql(spark, tmp_path):
    from helpers import sql_rows

    import shutil

    from codelode.plans import lexical_queries as Q

    for t in "region nation customer supplier part orders lineitem events embeddings pages labels conversations".split():
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    texts = ["a b a b a b", "a b, x a b a b", "x x x x", "b a b a", "a a b b", "a b a b x a b"]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(0, "a b"), (1, "x"), (2, "b a b")], "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    got = sorted((r.query_id, r.chunk_id, r.hits) for r in Q.phrase_match(spark, str(tmp_path)).collect())
    rows, cols = sql_rows(Q.SQL["phrase_match"], str(tmp_path))
    assert got == sorted((r[cols.index("query_id")], r[cols.index("chunk_id")], r[cols.index("hits")]) for r in rows)
