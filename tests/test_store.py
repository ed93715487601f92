import pytest

from codelode.sources.store import Cache, Store

KEYS = ["a" * 64, "b" * 64]


def test_store_changes_are_whole_and_read_back(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    c = spark.createDataFrame([(1, "x.py"), (2, "y.py")], "chunk_id long, file_path string")
    e = spark.createDataFrame([("x.py", "y.py"), ("y.py", "z.py"), ("z.py", "z.py")], "source string, target string")
    s.write({"k": "v"}, chunks=c, edges=e)
    assert s.get_metadata("k") == "v" and s.get_metadata("other") is None and not s.needs_reindex()
    bad = spark.createDataFrame([(1,)], "nothing int")
    with pytest.raises(Exception):
        s.replace_files(spark.createDataFrame([("x.py",)], "path string"), bad, e)
    assert s.table("chunks").count() == 2 and s.table("edges").count() == 3
    s.replace_files(spark.createDataFrame([("x.py",)], "path string"), spark.createDataFrame([(3, "x.py")], c.schema), spark.createDataFrame([], e.schema))
    assert sorted(r[0] for r in s.table("chunks").collect()) == [2, 3]
    assert sorted(map(tuple, s.table("edges").collect())) == [("y.py", "z.py"), ("z.py", "z.py")]
    s.upsert("chunks", spark.createDataFrame([(3, "w.py"), (4, "w.py")], c.schema), "chunk_id")
    assert sorted(map(tuple, s.lookup("chunks", "chunk_id", [3, 4, 9]).collect())) == [(3, "w.py"), (4, "w.py")]
    s.append("edges", s.table("edges"))
    assert s.table("edges").count() == 4
    s.migrate({"chunks": {"summary": "string", "chunk_id": "long"}})
    assert s.needs_reindex() and "summary" in s.table("chunks").columns
    s.clear_reindex()
    s.migrate({"chunks": {"another": "string"}})
    assert not s.needs_reindex() and "another" not in s.table("chunks").columns


def test_vectors_are_refused_where_they_do_not_belong(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    v = spark.createDataFrame([(1, [0.5, 1.0])], "id long, v array<double>")
    s.save_vectors("vectors", v, embedder="e", dim=2, mode="raw")
    assert s.load_vectors("vectors", v, embedder="e", dim=2).collect() == v.collect()
    with pytest.raises(ValueError):
        s.load_vectors("vectors", embedder="f")
    with pytest.raises(ValueError):
        s.load_vectors("vectors", v.union(v), embedder="e")


def test_cache(spark, tmp_path):
    c = Cache(spark, str(tmp_path))
    t = spark.createDataFrame([(1,)], "x int")
    assert c.get(KEYS[0]) is None and c.is_stale(KEYS[0]) and c.find("repo") is None
    for k, key in enumerate(KEYS):
        c.put(key, 1000.0 + k, f"c{k}", "repo", data=t)
    assert c.get(KEYS[0]).table("data").collect() == t.collect() and c.get_meta(KEYS[1])["commit"] == "c1"
    assert c.find("repo")[1] == "c1" and c.info().first().entries == 2
    assert c.clean(1, 1000.5 + 3600) == 1 and [r.key for r in c.list_entries().collect()] == [KEYS[1]]
    c.invalidate(KEYS[1])
    assert c.info().first()[:] == (0, 0)
    with pytest.raises(ValueError):
        c.get("../elsewhere")
