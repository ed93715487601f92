"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest

import corpus_pipeline
from codelode.llm import fingerprints, hmm, html_extract, langid, mixing, ngram_join, packing, pii, topk_search, toxicity

LONG = "the word and the other word is here " * 20000
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "DOC_ID", "grp", "shard", "token", "key", "slot", "block", "terms", "n", "item_id"]
DDL = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string, grp long, shard string, token int, key string, slot int, block string, terms string, n string, item_id long"
ROWS = [
    (1, "The house is on the hill and it is big.", "en", "s", 39),
    (1, "The house is on the hill and it is big.", "en", "s", 39),
    (2, "The house is on the hill and it is big.", "en", "s", 39),
    (3, None, None, None, None),
    (None, "no id at all but some text 12 @ x", "en", "s", 5),
    (4, "", "", "", 0),
    (5, " \n\t ", "de", "t", 4),
    (6, LONG, "en", "t", len(LONG)),
    (7, "a", None, None, 1),
    (8, "é中\U0001f600 \u0000 0 @@ ...", "fr", "u", 9),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame([(*r, "x", None, None, 1, None, 2, "b", None, "n", r[0]) for r in ROWS], DDL)


NET = langid.train([("en", "the house is on the hill and it is big"), ("de", "das haus ist auf dem berg und es ist gross")], steps=5)
OPERATORS = {
    "ngram_join": (ngram_join.ngram_jaccard_join, None),
    "near_duplicates": (ngram_join.drop_near_duplicates, None),
    "mixing": (lambda d: mixing.mix_sources(d, block=8), None),
    "keep_mixed": (lambda d: mixing.keep_mixed(d, block=8), None),
    "fingerprints": (fingerprints.fingerprints, 11),
    "fingerprint_report": (fingerprints.fingerprint_report, 8),
    "langid": (lambda d: langid.identify(d, NET), 11),
    "keep_accepted": (lambda d: langid.keep_accepted(d, NET), None),
    "langid_fitted": (langid.identify, 11),
    "pii": (pii.detect, 11),
    "redact": (pii.redact_documents, 11),
    "toxicity": (lambda d: toxicity.score_documents(d, toxicity.fit(d, d.toDF(*[f"c{k}" for k in range(len(NAMES))]).selectExpr("c0 as doc_id", "c8 as toxic"))), 11),
    "packing": (packing.pack, None),
    "hmm": (lambda d: hmm.score_documents(d, rounds=1), 11),
    "topk": (lambda d: topk_search.topk_search(d, d, 3), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hostile_rows(hostile, name):
    f, rows = OPERATORS[name]
    out = f(hostile).collect()
    assert rows is None or len(out) == rows


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name][0](spark.createDataFrame([], DDL)).collect() == []


def test_what_hostile_rows_give(hostile):
    pairs = {tuple(r)[:2] for r in ngram_join.ngram_jaccard_join(hostile).collect()}
    assert pairs == {(1, 2)}
    for f in (ngram_join.drop_near_duplicates, pii.redact_documents, lambda d: langid.keep_accepted(d, NET), lambda d: mixing.keep_mixed(d, block=8)):
        assert f(hostile).columns == NAMES
    assert sorted(str(r[0]) for r in ngram_join.drop_near_duplicates(hostile).collect()) == ["1", "1", "3", "4", "5", "6", "7", "8", "None", "None"]
    scores = {r.doc_id: r for r in hmm.score_documents(hostile, rounds=1).collect()}
    assert scores[3].n_words is None and scores[4].n_words == 0 and scores[4].perplexity is None
    top = [tuple(r)[:3] for r in topk_search.topk_search(hostile, hostile, 3).collect() if r.query_id == 1]
    assert [t[2] for t in sorted(top)][:2] == [1, 2]
    whole = {r.doc_id: r.n_bytes for r in fingerprints.fingerprints(hostile).collect()}
    assert whole[6] == len(LONG) and whole[3] == 0
    packed = packing.pack(hostile).collect()
    assert sum(e - b for r in packed for d, b, e in zip(r.doc_ids, r.begins, r.ends) if d == 6) == len(LONG.split())


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, hostile, k, tmp_path):
    docs = hostile.toDF(*NAMES[:5], *[f"c{j}" for j in range(5, len(NAMES))])
    for d in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[k][1](spark, d, str(tmp_path))
        out.write.mode("overwrite").parquet(str(tmp_path / "o"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == d.columns


def test_pages(spark):
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
