"""Scanning, parsing and resolving small repositories."""

import pytest
from pyspark.sql import functions as F

from codelode.operators import chunking
from codelode.sources import files, parse

REPO = {
    "src/app/main.py": "import os\nfrom .models import User as U\nfrom app.utils import helper\nif True:\n    import json\n\ndef main():\n    def inner(): pass\n    return U()\n\nif __name__ == '__main__':\n    main()\n",
    "src/app/models.py": "class User(Base):\n    \"\"\"A user.\"\"\"\n    @property\n    def name(self) -> str:\n        return ''\n    def _hidden(self): ...\n",
    "src/app/utils.py": "def helper(a: int, *, b=1):\n    return a\n",
    "src/app/__init__.py": "",  # Spark reads no rows from empty files
    "web/index.ts": "import { a } from './lib/util';\nexport interface Shape { area(): number }\nexport class Box {\n  grow(n: number): void {\n    if (n) { this.x = n; }\n  }\n}\n",
    "web/lib/util.ts": "export const a = 1;\nfunction own() {\n  return '}';\n}\n",
    "go/main.go": "package main\n\nimport (\n\t\"fmt\"\n\tx \"demo/handlers\"\n)\n\nfunc main() {\n\tfmt.Println(x.Run())\n}\n",
    "go/handlers/run.go": "package handlers\n\ntype T struct {\n}\n\nfunc (t *T) Run() int {\n\treturn 1\n}\n",
    "rs/lib.rs": "use crate::models::{Item, Kind};\n\npub trait Show {\n    fn show(&self);\n}\n\nimpl Show for Item {\n    fn show(&self) {\n    }\n}\n",
    "rs/models.rs": "pub struct Item {\n    pub n: i32,\n}\n\npub enum Kind {\n    A,\n}\n",
    "jv/Main.java": "import com.x.Service;\n\npublic class Main {\n    public static void main(String[] args) {\n        new Service();\n    }\n    private int n() {\n        return 1;\n    }\n}\n",
    "jv/com/x/Service.java": "package com.x;\n\npublic interface Service {\n    void run();\n}\n",
    "kt/App.kt": "import demo.Util\n\nclass App {\n    fun go() {\n    }\n}\n\nfun String.twice(): String {\n    return this\n}\n",
    "cs/Program.cs": "using Demo.Models;\n\nnamespace Demo\n{\n    public class Program\n    {\n        static void Main(string[] a)\n        {\n        }\n    }\n}\n",
    "sw/main.swift": "import Models\n\nstruct Point {\n    let x = 1\n    func go() {\n    }\n}\n",
    "node_modules/x/index.js": "module.exports = 1;\n",
    "bad.py": "def (:\n",
    "notes.txt": "no code\n",
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in REPO.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return files.scan(spark, str(root)).cache()


@pytest.fixture(scope="module")
def parsed(scanned):
    return parse.parse(scanned).cache()


def test_scan(scanned):
    assert {r.path for r in scanned.collect()} == set(REPO) - {"node_modules/x/index.js", "notes.txt", "src/app/__init__.py"}


def test_symbols(parsed):
    got = {(r.file_path, r.qualified_name): r for r in parse.symbols(parsed).collect()}
    assert got["src/app/models.py", "User"].docstring == "A user." and got["src/app/models.py", "User"].signature == "class User(Base)"
    assert got["src/app/models.py", "User.name"].start_line == 3 and got["src/app/models.py", "User._hidden"].visibility == "private"
    assert ("src/app/main.py", "inner") not in got and got["src/app/main.py", "main"].end_line == 9
    assert got["web/index.ts", "Box.grow"].kind == "method" and got["web/index.ts", "Box"].end_line == 7
    assert got["web/lib/util.ts", "own"].end_line == 4 and got["web/lib/util.ts", "own"].visibility == "private"
    assert got["go/handlers/run.go", "T.Run"].kind == "method" and got["go/main.go", "main"].visibility == "private"
    assert got["rs/lib.rs", "Show"].kind == "interface" and got["rs/lib.rs", "Item::show"].parent == "Item" and got["rs/models.rs", "Kind"].kind == "enum"
    assert got["jv/Main.java", "Main.main"].visibility == "public" and got["jv/Main.java", "Main.n"].visibility == "private" and got["jv/com/x/Service.java", "Service.run"].visibility == "public"
    assert got["kt/App.kt", "App.go"].kind == "method" and got["kt/App.kt", "String.twice"].parent == "String"
    assert got["cs/Program.cs", "Demo.Program"].kind == "class" and got["cs/Program.cs", "Demo.Program.Main"].kind == "method"
    assert got["sw/main.swift", "Point.go"].kind == "method"
    assert not any(p == "bad.py" for p, _ in got)


def test_resolution(parsed):
    got = {(r.file_path, r.module): r.resolved_path for r in parse.resolve(parse.imports(parsed), parsed.select("path")).collect()}
    assert got["src/app/main.py", ".models"] == "src/app/models.py" and got["src/app/main.py", "app.utils"] == "src/app/utils.py"
    assert got["src/app/main.py", "os"] is None and got["src/app/main.py", "json"] is None
    assert got["web/index.ts", "./lib/util"] == "web/lib/util.ts"
    assert got["go/main.go", "demo/handlers"] == "go/handlers/run.go" and got["go/main.go", "fmt"] is None
    assert got["jv/Main.java", "com.x.Service"] == "jv/com/x/Service.java"


def test_entry_points(scanned):
    got = {r.path for r in parse.entry_points(scanned).collect()}
    assert got == {"src/app/main.py", "go/main.go", "web/index.ts", "jv/Main.java", "cs/Program.cs", "sw/main.swift"}


def test_chunks_cover_all_lines(scanned, parsed):
    f = scanned.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("content"))
    got = chunking.chunk_files(f, parse.symbols(parsed)).collect()
    for path, text in REPO.items():
        own = "\n".join(r.content for r in got if r.file_path == path)
        if path in {r.file_path for r in got}:
            assert all(line in own for line in text.split("\n") if line.strip())
    assert {r.file_path for r in got} == {p for p in REPO if p not in ("node_modules/x/index.js", "notes.txt") and REPO[p].strip()}


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, file_path string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, file_path string")
    assert sorted(map(tuple, files.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.id for r in files.delete_files(old, spark.createDataFrame([("a",)], "path string"), ["file_path"]).collect()] == [2]
    files.save(old, str(tmp_path), "t")
    assert files.load(spark, str(tmp_path), "t").count() == 2
