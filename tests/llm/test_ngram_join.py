import random

import numpy as np
from helpers import assert_same

from codelode.llm import ngram_join as N


def brute(docs, n=N.N, threshold=N.THRESHOLD):
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = frozenset([tuple(w)] if len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
    reps, out = {}, set()
    for i in sorted(sets):
        r = reps.setdefault(sets[i], i)
        if r != i:
            out.add((r, i, 1.0))
    ids = sorted(reps.values())
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= threshold:
                out.add((a, b, round(j, 9)))
    return out


def corpus(sizes, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    docs = []
    for size in sizes:
        base = [rng.choice(vocab) for _ in range(size)]
        docs.append(base)
        for change in (0, 1, 2, size // 30, size // 15, size // 8):
            x = base[:]
            for _ in range(change):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            docs.append(x)
    rng.shuffle(docs)
    return [(k, " ".join(d)) for k, d in enumerate(docs)]


def got(df):
    return {(r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in df.collect()}


def test_short_documents_are_exact(spark):
    docs = corpus([2, 3, 5, 12, 20, 30, 40, 50, 60] * 3)
    assert got(N.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_long_documents_recall_and_exact_similarities(spark):
    docs = corpus([300, 500, 900, 1500] * 8)
    want, have = brute(docs), got(N.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")))
    assert have <= want
    assert len(have) >= 0.995 * len(want)


def classes(docs, **how):
    """(doc_id, class, links) by brute force."""
    root, links = {i: i for i, t in docs if t.split()}, {i: 0 for i, t in docs if t.split()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: frozenset([tuple(w)] if len(w) < N.N else [tuple(w[k : k + N.N]) for k in range(len(w) - N.N + 1)]) for i, t in docs if (w := t.lower().split())}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= N.THRESHOLD:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, find(i), links[i]) for i in ids}


def test_classes_and_links_against_brute_force(spark):
    docs = corpus([2, 3, 12, 30, 40, 60, 80] * 2)
    docs += [(1000 + k, docs[k % 9][1]) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = classes(docs)
    assert {tuple(r) for r in N.near_duplicate_classes(df).collect()} == want
    # groups divided, and compared in parts
    assert {tuple(r) for r in N.near_duplicate_classes(df, group=2).collect()} == want


def test_one_ngram_in_every_document(spark):
    docs = [(k, t + " all have this") for k, t in corpus([20, 30, 40] * 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in N.near_duplicate_classes(df, group=16).collect()} == classes(docs)


def test_sql(spark, tiny):
    assert_same(N.query(spark, tiny), N.ORACLE_SQL, tiny)


def test_one_of_each_group_stays(spark):
    docs = corpus([40, 80, 120])
    kept = {r.doc_id for r in N.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in brute(docs):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert kept == {find(i) for i, _ in docs}


def test_extra_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c d", 9, "x"), (2, "a b c d", 8, "y"), (None, "a b c d", 7, "z"), (3, None, 6, "n"), (3, "", 6, "n")], "doc_id long, text string, grp int, DOC_ID string")
    out = N.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(tuple(r)[2] for r in out.collect()) == [6, 6, 7, 9]


def test_long_pairs_at_the_very_threshold(spark):
    # 150 n-grams within 250; a sample of some 96 of them misses pairs 726 and 3870
    import corpus_pipeline

    docs = []
    for k in (1, 2, 726, 3870):
        rng = random.Random(k)
        w = [f"w{rng.randrange(10**6)}" for _ in range(252)]
        docs += [(2 * k, " ".join(w[:152])), (2 * k + 1, " ".join(w))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(N.ngram_jaccard_join(df)) == {(2 * k, 2 * k + 1, 0.6) for k in (1, 2, 726, 3870)}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [2, 4, 1452, 7740]


def test_long_documents_lose_nothing(spark):
    docs = corpus([110, 200, 300, 500, 900] * 4, seed=8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(N.ngram_jaccard_join(df)) == brute(docs)
    assert {tuple(r) for r in N.near_duplicate_classes(df, group=4).collect()} == classes(docs)


def test_a_cluster_sends_each_text_once(spark):
    # 120 different texts, each near to each other, of many least n-grams and so of many groups
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = []
    for k in range(120):
        x = base[:]
        for _ in range(4):
            x[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        docs.append((k, " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sent = []
    whole = N._sets

    def spied(*args):
        sent.append(whole(*args).count())
        return whole(*args)

    N._sets = spied
    try:
        assert {tuple(r) for r in N.near_duplicate_classes(df).collect()} == classes(docs)
        assert {tuple(r) for r in N.near_duplicate_classes(df, group=3).collect()} == classes(docs)
    finally:
        N._sets = whole
    # before: once for each of the groups that it opens
    assert sent[0] == 120 < sent[1]


def passages():
    """60 pairs of texts of 40 and 64 words that have a passage of 10 words in common, and one pair of near copies."""
    rng = random.Random(5)
    docs = []
    for k in range(60):
        a, b = ([f"w{rng.randrange(10**6)}" for _ in range(size)] for size in (40, 64))
        b[20:30] = a[10:20]
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    return [*docs, (500, docs[7][1] + " end"), (501, docs[8][1][:-1])]


def test_texts_that_share_a_passage_are_not_sent(spark):
    docs, sent, whole = passages(), [], N._sets

    def spied(*args):
        got = whole(*args)
        sent.append(got.count())
        return got

    N._sets = spied
    try:
        assert {tuple(r) for r in N.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == classes(docs)
    finally:
        N._sets = whole
    # before: every text that opens a group, or whose group is opened
    assert sent == [4]


def test_bitmaps_lose_no_pair():
    rng = np.random.default_rng(6)
    for threshold in (0.3, 0.5, 0.6, 0.95):
        sets = []
        for size in (1, 3, 31, 32, 33, 63, 64, 65, 100, 129, 250, 1000):
            base = rng.integers(0, 1 << 48, size)
            sets += [base, *(np.unique(np.concatenate([base[: max(1, int(size * part))], rng.integers(0, 1 << 48, new)])) for part in (0.3, 0.6, 0.8, 1) for new in (0, 1, size // 4, size))]
        bits = N._bitmaps(np.concatenate(sets), np.array([len(x) for x in sets])).to_pylist()
        screen = N._Screen(list(range(len(sets))), [len(x) for x in sets], [k % 3 for k in range(len(sets))], bits, threshold)
        left = 0
        for a, x in enumerate(sets):
            got = screen.may(a, len(x), bits[a], [0, 2, 7]).tolist()
            want = {b for b, y in enumerate(sets) if b != a and b % 3 != 1 and len(c := np.intersect1d(x, y)) / (len(x) + len(y) - len(c)) >= threshold}
            assert want <= set(got) and len(got) == len(set(got))
            left += len(got) - len(want)
        # most of the others are told apart; at low thresholds bitmaps of this size tell little
        assert threshold < 0.6 or left < 0.05 * len(sets) ** 2


def test_frequent_ngrams_show_in_an_input_of_any_size(spark, monkeypatch):
    # 60 of 4000 documents share an n-gram; a sample of about 100 of them has it once or twice, too seldom to tell
    monkeypatch.setattr(N, "COMMON_DOCS", 100)
    rows = [(k, f"w{k} v{k} u{k} " + ("one two three " if k % 67 == 0 else f"x{k} y{k} z{k} ")) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(N._common(docs, 3)[0]) == 1
    monkeypatch.setattr(N, "COMMON", 0)
    assert len(N._common(docs, 3)[0]) == 0


def test_only_the_ids_to_leave_out_stay_written(spark):
    import os

    from codelode.llm.common import shared_folder

    at = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(at))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "u v w x y z")], "doc_id long, text string")
    out = N.drop_near_duplicates(docs)
    assert [x.partition("-")[0] for x in set(os.listdir(at)) - before] == ["lost"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
