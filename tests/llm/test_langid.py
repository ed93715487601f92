import numpy as np

from codelode.llm import langid as L


def test_gradients():
    rng = np.random.default_rng(0)
    net = L._start(["a", "b", L.UNDETERMINED], 3, rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    idx, y = rng.integers(0, 257, (6, 5)), rng.integers(0, 3, 5)
    _, grad = L._train_step(net, idx, y)
    for k, w in net.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if k.startswith("E"):
                at = (at[0], idx[rng.integers(6), rng.integers(5)])
            was, eps, loss = w[at], 1e-4, []
            for d in (eps, -eps):
                w[at] = was + d
                loss.append(L._train_step(net, idx, y)[0])
            w[at] = was
            assert abs((loss[0] - loss[1]) / (2 * eps) - grad[k][at]) < 2e-3


def test_scan_equals_plain_recursion():
    rng = np.random.default_rng(1)
    net = L._start(["a", L.UNDETERMINED], 4, rng)
    raw = np.frombuffer("abc déf ghi".encode(), np.uint8)
    idx, _ = L._segments(raw, np.array([0, len(raw)]), 16)
    p = L._probabilities(net, idx)[: len(raw), :, 0]
    w, H = net.weights, 4
    logits = np.repeat(w["c"].T, len(raw), 0)
    for d, order in (("f", range(len(raw))), ("b", range(len(raw) - 1, -1, -1))):
        h = np.zeros(H)
        for t in order:
            x, u = w[f"E{d}"][:, raw[t]], w[f"U{d}"] @ h
            z, r = (1 / (1 + np.exp(-(x[k : k + H] + u[k : k + H]))) for k in (0, H))
            n = np.tanh(x[2 * H :] + r * u[2 * H :])
            h = n + z * (h - n)
            logits[t] += w[f"W{d}"] @ h
    e = np.exp(logits)
    assert np.allclose(p, e / e.sum(1, keepdims=True), atol=1e-4)


def test_held_out_accuracy_and_noise(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = L.fit(docs.where("doc_id < 500"))
    got = L.identify(docs.where("doc_id >= 500"), net).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    sure = [r for r in got if r.accepted and r.n_chars >= 40]
    assert sum(r.language == r.lang for r in sure) >= 0.97 * len(sure)
    assert len(sure) >= 0.85 * sum(r.n_chars >= 40 for r in got)
    rng = np.random.default_rng(3)
    junk = [(k, L._noise(rng, 600).tobytes().decode("utf-8", "ignore")) for k in range(60)]
    out = L.identify(spark.createDataFrame(junk, "doc_id long, text string"), net).collect()
    assert sum(not r.accepted for r in out) >= 55
    text = docs.first().text
    labels = L.label_positions(net, text)
    assert len(labels) == len(text.encode())
    row = L.identify(docs.limit(1), net).first()
    assert {k: v for k, v in row.label_counts.items() if v} == {k: labels.count(k) for k in set(labels)}
