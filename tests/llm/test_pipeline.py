import corpus_pipeline as C
from codelode.llm import common, langid, mixing, ngram_join, pii


def test_stages_take_effect_in_order(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    net = langid.fit(docs)
    accepted = {r.doc_id for r in langid.identify(docs, net).where("accepted").collect()}
    one = C.language(spark, docs, tiny).cache()
    assert {r.doc_id for r in one.collect()} == accepted
    clean = [i for i, r in rows.items() if r.n_chars > 200]
    assert len(accepted & set(clean)) > 0.9 * len(clean)
    # near duplicates against brute force over whole texts
    from test_ngram_join import brute
    import re

    words = {r.doc_id: " ".join(re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", r.text.lower())) for r in one.collect()}
    words = {i: w for i, w in words.items() if w}
    root = {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in brute(sorted(words.items())):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    two = C.near_duplicates(spark, one, tiny).cache()
    assert {r.doc_id for r in two.collect()} & set(words) == {find(i) for i in words}
    three = C.personal_data(spark, two, tiny).cache()
    model = pii.fitted()
    for r in three.collect():
        raw = rows[r.doc_id].text.encode()
        assert r.text == pii.redact(raw, pii.find(model, rows[r.doc_id].text)).decode() and r.n_chars == len(r.text)
    four = C.mixture(spark, three, tiny).cache()
    scheduled = {r.doc_id for r in mixing.mix_sources(three).where("from_token = 0").collect()}
    assert scheduled <= {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    packed = {d for r in C.packed(spark, four, tiny).collect() for d in r.doc_ids}
    assert packed <= {r.doc_id for r in four.collect()} and scheduled <= packed
    assert packed == {d for r in C.run(spark, tiny).collect() for d in r.doc_ids}
    assert ngram_join.N == 3


def test_only_the_last_stage_is_left_behind(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert C.run(spark, tiny).count()
    left = [p.name for p in tmp_path.iterdir()]
    assert len(left) == 1 and left[0].startswith("stage-packing")


def test_near_duplicates_leaves_texts_where_they_are(spark):
    docs = [(k, " ".join(f"w{k % 20}x{j}" for j in range(40))) for k in range(30)] + [(None, "a null id stays"), (3, "a null id stays")]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted([*map(str, range(20)), "3", "None"])
        # before: all texts were shuffled to leave out ten ids
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_packing_writes_as_many_tables_however_often_it_searches(spark, monkeypatch):
    # plans and tables of each search were kept by the driver; lists of one filler make it search again and again
    from codelode.llm import packing

    written = []
    monkeypatch.setattr(packing, "materialize", lambda df, name: written.append(name) or common.materialize(df, name))
    docs = [(k, " ".join(f"t{k % 3}w{j}" for j in range(k % 11, k % 11 + 8))) for k in range(100, 160)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = packing.pack(df, window=200, depth=1, passes=1).collect()
    assert sorted(d for r in out for d in r.doc_ids) == [d for d, _ in docs]
    assert len(next(r for r in out if r.doc_ids[0] == 100).doc_ids) > 15
    assert written.count("index") == 1 and len(written) < 10
