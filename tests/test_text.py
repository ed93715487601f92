"""Text functions and operators by hand-made examples."""

import pytest
from pyspark.sql import functions as F

from codelode.functions import intent, porter
from codelode.functions import text as T
from codelode.operators import analyze, chunking, snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "question, kind",
    [
        ("Where is SessionPool defined?", "definition_lookup"),
        ("why does it raise", "debugging"),
        ("who calls open_session", "usage_search"),
        ("HTTPClient send_request", "definition_lookup"),
        ("overview of the middleware pipeline and how everything in it hangs together", "architecture_broad"),
        ("how are values kept", "general"),
        ("", "general"),
    ],
)
def test_intent(spark, question, kind):
    assert one(spark, intent.classify(F.lit(question))) == kind


def test_weights_add_up():
    assert all(abs(sum(w) - 1) < 1e-9 for w in intent.WEIGHTS.values())


def test_identifiers(spark):
    assert one(spark, T.expand_identifiers(F.lit("getUserName of http_client"))) == "getUserName of http_client\nclient get http name user"
    assert one(spark, T.compound_split(F.lit("HTTPServer"))) == ["HTTPServer", "http", "server"]
    assert one(spark, T.compound_split(F.lit("a_bc"))) == ["a_bc", "a", "bc"]
    assert one(spark, T.symbol_id(F.lit("a.py"), F.lit("C.m"), F.lit("method"))) == "a.py::C.m#method"
    assert one(spark, T.symbol_id(F.lit("a.py"), F.lit(None), F.lit(None))) == "a.py::_module#module"
    assert one(spark, T.module_of(F.lit("src/a/b/__init__.py"))) == "a.b"
    assert one(spark, T.matches_ignore(F.lit("x/foo.egg-info/y"), ["*.egg-info/"]))


def test_stemmer():
    assert [porter.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "hoping", "sky")] == ["caress", "poni", "relat", "hop", "hope", "sky"]


def test_packing_lines(spark):
    assert one(spark, chunking.pack_starts(F.array(*[F.lit(x).cast("long") for x in (3, 3, 9, 1, 1)]), 5)) == [1, 2, 3, 4]
    assert one(spark, chunking.pack_starts(F.array().cast("array<long>"), 5)) == []


def naive_merge(cands, least):
    cands, out, i = list(cands), [], 0
    while i < len(cands):
        p, s, t = cands[i]
        if t < least and s is None:
            if i + 1 < len(cands) and cands[i + 1][1] is None:
                cands[i + 1] = (p + cands[i + 1][0], None, t + cands[i + 1][2])
                i += 1
                continue
            if out and out[-1][1] is None:
                out[-1] = (out[-1][0] + p, None, out[-1][2] + t)
                i += 1
                continue
        out.append((p, s, t))
        i += 1
    return out


def test_merging_against_a_plain_loop(spark):
    import random

    rng, rows, want = random.Random(1), [], {}
    for f in range(60):
        c = [([k], rng.choice([None, None, "s"]), rng.randrange(1, 90)) for k in range(rng.randrange(1, 9))]
        rows += [(f"f{f}", k[0], k[0] * 10, s, t) for k, s, t in c]
        want[f"f{f}"] = naive_merge(c, 50)
    got = {}
    df = spark.createDataFrame(rows, "file_path string, pos int, start_line long, symbol string, token_count long")
    for r in chunking.merge_small(df).orderBy("file_path", "place").collect():
        got.setdefault(r.file_path, []).append((r.pieces, r.symbol, r.token_count))
    assert got == want


def test_uncovered(spark):
    s = spark.createDataFrame([("f", 2, 3), ("f", 3, 5), ("f", 8, 8)], "file_path string, start_line int, end_line int")
    f = spark.createDataFrame([("f", 10), ("g", 4)], "file_path string, total_lines int")
    assert sorted(map(tuple, chunking.uncovered(s, f).collect())) == [("f", 1, 1), ("f", 6, 7), ("f", 9, 10), ("g", 1, 4)]


def test_parameters(spark):
    got = one(spark, analyze.parameters(F.lit("def f(self, a: dict[str, int], b=(1, 2), *args, c: int = 3, **kw) -> list[int]:")))
    assert [tuple(x) for x in got] == [("a", "dict[str, int]", None, True), ("b", None, "(1, 2)", False), ("c", "int", "3", False), ("kw", None, None, False)]
    assert one(spark, analyze.return_type(F.lit("def f() -> list[int]:"))) == "list[int]"


def test_delta(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), ("old", "4")], "path string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("new", "4"), ("n", "7")], "path string, hash string")
    assert sorted(map(tuple, snapshots.delta(a, b).collect())) == [("n", "A", None), ("new", "R", "old"), ("y", "M", None), ("z", "D", None)]
