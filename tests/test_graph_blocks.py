"""Pairs of a directory's files."""

from codelode.operators import graph


def test_directory_pairs_are_not_shuffled(spark):
    paths = [f"{d}/f{k}" for d in "ab" for k in range(30)] + ["top", "other"]
    edges = [("a/f0", "a/f1"), ("a/f0", "b/f2"), ("b/f3", "b/f3"), ("top", "other"), ("a/f5", "gone")]
    p, e = spark.createDataFrame([(x,) for x in paths + ["a/f0"]], "path string"), spark.createDataFrame(edges, "source string, target string")
    out = graph.co_directory(p, e, block=7)
    top = lambda x: x.rpartition("/")[0]
    want = {(x, y) for x in paths for y in paths if x != y and top(x) == top(y)} - set(edges)
    got = [(r.source, r.target) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "LeftAnti" not in out._jdf.queryExecution().executedPlan().toString()
