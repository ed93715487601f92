import time

import numpy as np

from codelode.llm import pii as P


def test_regions_lose_nothing_against_whole_texts():
    model, rng = P.fitted(), np.random.default_rng(9)
    for _ in range(60):
        text = "".join(t for t, _ in P._generate(rng)) + " plain words\tand\nmore, here. "
        tokens = P._tokens(text)
        at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in tokens])])
        want = [(int(at[i]), int(at[j]), k) for i, j, k in P.decode(model, tokens)]
        assert P.find(model, text) == want


def test_decoding_against_all_segmentations():
    model = P.fitted()

    def best(cands, scores, n, at=0):
        out = (best(cands, scores, n, at + 1) if at < n else 0.0) if at < n else 0.0
        for c, s in zip(cands, scores):
            if c[0] == at:
                out = max(out, s.max() + best(cands, scores, n, c[1]))
        return out

    for text in ("call 555-123-4567 now", "a@b.com 10.0.0.1", "12 34", "x@y z@w.org 1.2.3.4."):
        tokens = P._tokens(text)
        cands = P.candidates(tokens)
        scores = P._scores(model, cands)
        by = {(c[0], c[1]): s for c, s in zip(cands, scores)}
        got = sum(by[i, j][P.TYPES.index(k)] for i, j, k in P.decode(model, tokens))
        assert abs(got - best(cands, scores, len(tokens))) < 1e-9


def test_likelihood_gradient():
    rng = np.random.default_rng(2)
    tokens = P._tokens("id 555-12 a@b.co")
    model = {f: rng.normal(0, 0.3, len(P.TYPES)) for c in P.candidates(tokens) for f in c[2]}
    gold = {(P.candidates(tokens)[0][0], P.candidates(tokens)[0][1], P.TYPES[1])}
    _, grads = P._gradient(model, tokens, gold)
    total = {}
    for f, g in grads:
        for name in f:
            total[name] = total.get(name, 0) + g
    for name in list(model)[::5]:
        for y in (0, 1):
            was, ll = model[name][y], []
            for d in (1e-5, -1e-5):
                model[name][y] = was + d
                ll.append(P._gradient(model, tokens, gold)[0])
            model[name][y] = was
            assert abs((ll[0] - ll[1]) / 2e-5 - total.get(name, np.zeros(7))[y]) < 2e-2


def test_held_out_lines():
    model, rng = P.fitted(), np.random.default_rng(77)
    hit = missed = wrong = 0
    for _ in range(250):
        text, gold = "", set()
        for t, k in P._generate(rng):
            if k:
                gold.add((len(text.encode()), len((text + t).encode()), k))
            text += t
        found = set(P.find(model, text))
        hit, missed, wrong = hit + len(gold & found), missed + len(gold - found), wrong + len(found - gold)
    assert hit >= 0.95 * (hit + missed) and wrong <= 0.05 * hit


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "Mail ana.b@corp.example.com or +1 (555) 123-4567, née 10.", "k"), (2, None, "k"), (3, "", "k"), (4, "nothing here", "k")], "doc_id long, text string, TEXT2 string")
    out = {r.doc_id: r for r in P.detect(df).collect()}
    assert out[1].redacted == "Mail <EMAIL> or <PHONE>, née 10."
    assert out[2].spans is None and out[2].redacted is None
    assert out[3].spans == [] and out[3].redacted == "" and out[4].redacted == "nothing here"
    assert P.redact_documents(df).columns == df.columns


def test_clean_documents_stay_as_they_are(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("not text rlike '[0-9@]'")
    want = {r.doc_id: r.text for r in docs.collect()}
    assert want and {r.doc_id: r.redacted for r in P.detect(docs).collect()} == want


def test_long_entities_are_found_whole():
    model = P.fitted()
    mail = "john.a.b.c.d.e.f.g.h.smith@mail.corp.example.com"
    key = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwi-bmFtZSI6I_kpvaG4gRG9lIiwi-aWF0Ijox-NTE2MjM5MDIyfQ.SflKxwRJSMeKKF2QT4fw-pMeJf36POk6yJV_adQssw5c"
    for text, kind in ((mail, "EMAIL"), (key, "SECRET")):
        for around in ("mail {} now", "token = {}", "see {}"):
            s = around.format(text)
            i = s.index(text)
            assert (i, i + len(text), kind) in P.find(model, s), (s, P.find(model, s))


def test_long_numbers_and_addresses_take_time_in_proportion():
    model = P.fitted()
    for piece in ("1 ", "@", "12,34.5@", "1.", "7-", "a1 "):
        began = time.process_time()
        P.find(model, piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 40, piece
