import itertools

import numpy as np

from codelode.llm import hmm as H


def model(states=3, symbols=7, seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.random((symbols, states))
    move = rng.random((states, states))
    start = rng.random(states)
    return H.Model(np.zeros(0, np.uint64), start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def enumerate_paths(m, x):
    k = len(m.start)
    total, starts, moves, emissions = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)
    for path in itertools.product(range(k), repeat=len(x)):
        p = m.start[path[0]] * m.emit[x[0], path[0]]
        for a, b, s in zip(path, path[1:], x[1:]):
            p *= m.move[a, b] * m.emit[s, b]
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for s, b in zip(x, path):
            emissions[s, b] += p
    return total, starts / total, moves / total, emissions / total


def test_likelihood_and_counts_against_all_paths():
    m, rng = model(), np.random.default_rng(5)
    seqs = [rng.integers(0, 7, n).tolist() for n in (1, 2, 5, 6, 3)] + [[]]
    flat, first = np.array(sum(seqs, [])), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    want = [enumerate_paths(m, s) for s in seqs if s]
    assert np.allclose(H.log_likelihoods(m, flat, first), [np.log(w[0]) for w in want] + [0.0])
    starts, moves, emissions, ll = H.expected_counts(m, flat, first)
    for got, k in ((starts, 1), (moves, 2), (emissions, 3)):
        assert np.allclose(got, sum(w[k] for w in want), atol=1e-4)
    assert np.isclose(ll, sum(np.log(w[0]) for w in want), atol=1e-3)


def test_stretches_change_nothing():
    m, rng = model(4, 30, 3), np.random.default_rng(6)
    first = np.concatenate([[0], np.cumsum([1, 40, 7, 0, 8, 16, 100, 3, 33])])
    flat = rng.integers(0, 30, first[-1])
    want, ll = H.expected_counts(m, flat, first, 1000), H.log_likelihoods(m, flat, first, 1000)
    for segment in (1, 2, 8, 16):
        got = H.expected_counts(m, flat, first, segment)
        for a, b in zip(got, want):
            assert np.allclose(a, b, rtol=1e-4, atol=1e-4)
        assert np.allclose(H.log_likelihoods(m, flat, first, segment), ll)
    # all paths of one sequence, cut in the middle of it
    x = flat[:6].tolist()
    p, starts, moves, emissions = enumerate_paths(model(3, 30, 1), x)
    got = H.expected_counts(model(3, 30, 1), np.array(x), np.array([0, 6]), 2)
    assert np.allclose(got[0], starts, atol=1e-4) and np.allclose(got[1], moves, atol=1e-4) and np.allclose(got[2], emissions, atol=1e-4)


def test_training_raises_the_likelihood_and_scores_are_exact(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(5)
    m, rows, heard = H.train(docs, rounds=4)
    assert all(b > a for a, b in zip(heard, heard[1:]))
    got = {r.doc_id: r for r in H.score_symbols(rows, m).collect()}
    for r in rows.collect():
        a, total = None, 0.0
        for s in r.symbols:
            a = (m.start if a is None else a @ m.move) * m.emit[s]
            total += np.log(a.sum())
            a = a / a.sum()
        assert got[r.doc_id].n_words == len(r.symbols)
        assert abs(got[r.doc_id].log_likelihood - total) < 1e-3


def test_counts_do_not_depend_on_the_partitions(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    a, b = (H.train(docs.repartition(n), rounds=1)[2][0] for n in (1, 7))
    assert abs(a - b) < 1e-5 * abs(a)


def test_probabilities_of_all_words_add_up_to_one(spark):
    words = [(k, f"w{k}") for k in range(40)]
    docs = spark.createDataFrame(words + [(100 + k, " ".join([f"w{k % 40}"] * (1 + k % 3))) for k in range(90)], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in H.score_documents(docs, vocabulary=6, others=3, rounds=1).collect()}
    assert abs(sum(np.exp(got[k]) for k, _ in words) - 1) < 1e-3
