"""Patterns of files of many classes."""

from codelode.operators import analyze as A


def test_no_row_carries_all_classes_of_its_file(spark, monkeypatch):
    rows = [("f.py", f"Impl{k}", True, ["run"], ["run"]) for k in range(300)] + [("f.py", "SortPolicy", True, ["run"], ["run"]), ("f.py", "Plain", True, ["other"], ["other"]), ("g.py", "Alone", True, ["run"], ["run"])]
    c = spark.createDataFrame(rows, "file_path string, name string, top boolean, methods array<string>, all_methods array<string>")
    held = []
    monkeypatch.setattr(A, "materialize", lambda df, name: held.append(df) or df)
    got = {r.name: r.role for r in A.strategy(c).collect()}
    assert got == {f"Impl{k}": "concrete" for k in range(300)} | {"SortPolicy": "protocol"}
    assert held and all(len(str(r)) < 200 for df in held for r in df.collect())
