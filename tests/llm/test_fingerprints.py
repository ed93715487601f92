import numpy as np
import xxhash

from codelode.llm import fingerprints as P


def slow_chunks(raw):
    out, s, h = [], 0, 0
    hashes = []
    for c in raw:
        h = (2 * h + int(P.GEAR[c])) % (1 << 64)
        hashes.append(h)
    while s < len(raw):
        e = len(raw)
        for k in range(s + P.LEAST, len(raw)):
            bits = P.STRICT if k < s + P.NORMAL else P.LOOSE
            if hashes[k - 1] >> (64 - bits) == 0 or k == s + P.MOST:
                e = k
                break
        out.append(raw[s:e])
        s = e
    return out


def texts():
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "été", "ñandú", "x", "42"]
    return [" ".join(rng.choice(words, n)) for n in (0, 1, 5, 40, 200, 2000, 20000)]


def test_boundaries_against_a_plain_loop(spark):
    docs = [(k, t) for k, t in enumerate(texts())]
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, t in docs:
        chunks = slow_chunks(t.encode())
        want = {}
        for c in chunks:
            want[xxhash.xxh3_64_intdigest(c) >> 7] = len(c)
        assert got[k].n_chunks == len(chunks)
        assert dict(zip(got[k].digests, got[k].lengths)) == want


def test_an_insertion_changes_few_chunks(spark):
    rng = np.random.default_rng(2)
    t = " ".join(f"w{x}" for x in rng.integers(0, 5000, 8000))
    u = t[:20000] + " inserted here " + t[20000:]
    prints = P.fingerprints(spark.createDataFrame([(1, t), (2, u)], "doc_id long, text string"))
    r = P.containment(prints, spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "doc_a long, doc_b long")).collect()
    c = {(x.doc_a, x.doc_b): x.containment for x in r}
    assert c[1, 1] == 1.0 and c[1, 2] > 0.9 and c[2, 1] > 0.9


def brute(prints, threshold=P.THRESHOLD):
    """doc_id -> (copy_of, repeated, class, links, partner, containment)."""
    reps = {}
    copy = {i: (reps.setdefault(frozenset(p), i) if p else i) for i, p in sorted(prints.items())}
    weight = {i: sum(p.values()) for i, p in prints.items()}
    root, links, best = {i: copy[i] for i in prints}, {i: 0 for i in prints}, {i: (0, 0) for i in prints}
    held = {}
    for i in prints:
        if copy[i] == i:
            for d in prints[i]:
                held.setdefault(d, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in prints if prints[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = sum(n for d, n in prints[a].items() if d in prints[b])
            if common >= threshold * min(weight[a], weight[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                if copy[a] != copy[b]:
                    best[a] = min(best[a], (-common / weight[a], copy[b]))
                    best[b] = min(best[b], (-common / weight[b], copy[a]))
    out = {}
    for i, p in prints.items():
        again = sum(n for d, n in p.items() if len(held[d]) > 1)
        s, partner = best[i]
        out[i] = (copy[i], round(again / weight[i], 6) if p else 0.0, find(i), links[i], partner if s else None, round(-s, 6) if s else None)
    return out


def report(df, **how):
    return {r.doc_id: (r.copy_of, r.repeated, r.class_id, r.links, r.partner, r.containment) for r in P.fingerprint_report(df, **how).collect()}


def same(got, want):
    assert set(got) == set(want)
    for i in want:
        assert got[i][:1] + got[i][2:5] == want[i][:1] + want[i][2:5], (i, got[i], want[i])
        assert abs(got[i][1] - want[i][1]) < 2e-6 and (got[i][5] is None) == (want[i][5] is None) and abs((got[i][5] or 0) - (want[i][5] or 0)) < 2e-6


def chunk_sets(docs):
    return {i: dict((xxhash.xxh3_64_intdigest(c) >> 7, len(c)) for c in slow_chunks(t.encode())) for i, t in docs}


def test_report_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    same(report(docs), brute(chunk_sets([(r.doc_id, r.text) for r in docs.collect()])))


def test_copies_parts_and_shared_passages_against_brute_force(spark):
    rng = np.random.default_rng(8)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(n))
    passage, docs = some(60), []
    for k in range(12):
        base = some(150)
        docs += [base, base, base + " " + some(100), base[:500], some(40) + " " + passage, base[:600] + passage, ""]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(chunk_sets(docs))
    same(report(df), want)
    same(report(df, group=2), want)


def test_joined_instead_of_broadcast(spark, tiny, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", -1)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    same(report(docs), brute(chunk_sets([(r.doc_id, r.text) for r in docs.collect()])))


def test_passages_of_fifty_words_are_found(spark):
    rng = np.random.default_rng(3)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(n))
    docs, pairs = [], []
    for k in range(40):
        passage = some(50)
        docs += [(2 * k, f"{some(150)} {passage} {some(170)}"), (2 * k + 1, f"{some(90)} {passage} {some(60)}")]
        pairs.append((2 * k, 2 * k + 1))
    prints = P.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    found = P.containment(prints, spark.createDataFrame(pairs, "doc_a long, doc_b long")).where("shared > 0").count()
    assert found == 40
