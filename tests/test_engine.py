"""From a small repository to answers."""

from test_sources import REPO

from codelode import engine


def test_index_and_query(spark, tmp_path):
    root = tmp_path / "repo"
    for path, text in REPO.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    store = engine.index_repository(spark, str(root), str(tmp_path / "index"))
    assert {tuple(r) for r in store.table("edges").collect()} >= {("src/app/main.py", "src/app/models.py"), ("src/app/main.py", "src/app/utils.py"), ("web/index.ts", "web/lib/util.ts")}
    assert [r.file_path for r in store.table("files").where("parse_error").collect()] == ["bad.py"]
    names = {(r.file_path, r.symbol_name) for r in store.table("chunks").collect()}
    assert ("src/app/models.py", "User") in names and {f for f, _ in names} == {r.file_path for r in store.table("files").collect()}
    q = spark.createDataFrame([(1, "where is the helper function", 8192), (2, "class User name", 8192), (3, "zzz nothing", 8192)], "query_id long, question string, budget long")
    got = engine.query(store, q).collect()
    best = {r.query_id: r.file_path for r in got if r.place == 1}
    assert best == {1: "src/app/utils.py", 2: "src/app/models.py"}
    assert all(r.used <= 8192 for r in got)
    said = {r.query_id: r for r in engine.answer(store, q).collect()}
    assert "def helper" in said[1].markdown and "<chunk file=" in said[2].xml
    p = engine.profile(store)
    assert p["stats"].where("language = 'python'").first().files == 4
    assert "helper" in {r.name for r in p["interfaces"].collect()}
