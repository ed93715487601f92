"""Scores summed up in blocks of chunks, against the joins."""

import random

import pytest

from codelode.operators import accumulate, lexical


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_give_what_joins_give(spark, monkeypatch, kind):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    chunks = [(k if kind == "long" else f"c{k}", " ".join(rng.choices(words, k=rng.randrange(1, 9))), f"{rng.choice(words)}/p.py") for k in range(200)] + [(999 if kind == "long" else "none", None, None)]
    df = spark.createDataFrame(chunks, f"chunk_id {kind}, content string, file_path string")
    q = spark.createDataFrame([(k, " ".join(rng.choices(words, k=k + 1))) for k in range(6)] + [(7, "the"), (8, "nothing")], "query_id long, question string")
    fields = ["content", "file_path"]
    monkeypatch.setattr(accumulate, "CELLS", 60)
    monkeypatch.setattr(accumulate, "CONTRIBUTIONS", 90)
    assert lexical.Index.of(df, q, fields) is not None

    def run():
        found = [lexical.bm25(df, q, fields, 5), lexical.all_terms_match(df, q, fields, 5), lexical.search(df, q, fields, 5), *(lexical.graduated(df, q, fields, 5, enough=e) for e in (1, 10, 60)), lexical.average_idf(df, q, fields)]
        return [sorted(tuple((c, round(v, 9) if isinstance(v, float) else v) for c, v in sorted(r.asDict().items())) for r in x.collect()) for x in found]

    blocks = run()
    monkeypatch.setattr(lexical, "SENT_WORDS", -1)
    assert lexical.Index.of(df, q, fields) is None
    assert blocks == run()


def test_ids_that_repeat_are_joined(spark):
    df = spark.createDataFrame([(1, "a b", "p"), (1, "b c", "q")], "chunk_id long, content string, file_path string")
    q = spark.createDataFrame([(1, "b")], "query_id long, question string")
    assert lexical.Index.of(df, q, ["content", "file_path"]) is None
    assert [r.chunk_id for r in lexical.bm25(df, q, ["content", "file_path"]).collect()] == [1]
