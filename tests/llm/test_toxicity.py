import numpy as np

from codelode.llm import toxicity as X


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        s, y = rng.integers(0, 6, 12).astype(float), rng.integers(0, 2, 12).astype(float)
        at, p = X.isotonic(s, y)
        fit = p[np.searchsorted(at, s, "right") - 1]
        assert (np.diff(p) > -1e-12).all()
        # min-max formula of isotonic regression
        u = np.unique(s)
        mean = lambda a, b: y[(s >= a) & (s <= b)].mean()
        want = {x: max(min(mean(a, b) for b in u if b >= x) for a in u if a <= x) for x in u}
        assert np.allclose(fit, [want[x] for x in s])


def test_trees_separate_what_one_cut_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((X._score(X.boost(x, y), x) > 0) == y).mean() > 0.95


def test_held_out(spark):
    large = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    model = X.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = X.score_documents(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), "doc_id").collect()
    toxic, clean = [r for r in got if r.label], [r for r in got if not r.label]
    assert sum(r.toxic for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.toxic for r in clean) <= 0.03 * len(clean)


def test_nulls_and_no_labels(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "You are an idiot", 1), (3, "fine", 1), (3, "fine", 1)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = X.score_documents(df, X.fit(df, none)).collect()
    assert len(out) == 5 and all(r.probability == 0 and not r.toxic for r in out)
