"""Operator 5: language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in segments of SEGMENT bytes, forwards and backwards, each segment from a
zero state; every byte of every segment gets a probability for each language and for "und" (no language), and a
document's probabilities are the means over its bytes. It is trained here, in numpy, by backpropagation through time,
on windows of at most ROWS_PER_LANGUAGE labelled documents of each language and on generated noise for "und".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick
from .textops import buffers, slices

SEGMENT = 96
HIDDEN = 8
#: The bound of the labelled sample: the documents of least hash.
ROWS_PER_LANGUAGE = 300
STEPS = 260
BATCH = 192
SEED = 20240501
UNDETERMINED = "und"
#: Rejected are documents with at least this probability of no language.
REJECT = 0.7
_PAD = 256
_BYTES = 1 << 18


@dataclass
class Network:
    labels: list[str]
    hidden: int
    #: for each direction: input table (3H, 257), recurrent weights (3H, H), output weights (C, H); rows z, r, n
    weights: dict[str, np.ndarray]


def _start(labels: list[str], hidden: int, rng: np.random.Generator) -> Network:
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        w[f"E{d}"] = rng.normal(0, 0.4, (3 * hidden, 257)).astype(np.float32)
        w[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
        w[f"W{d}"] = rng.normal(0, 0.3, (len(labels), hidden)).astype(np.float32)
        w[f"E{d}"][:hidden] += 0.5
    w["c"] = np.zeros((len(labels), 1), np.float32)
    return Network(labels, hidden, w)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _train_step(net: Network, idx: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients; idx is (time, batch) of bytes, y (batch) of labels."""
    H, (n_t, B), w = net.hidden, idx.shape, net.weights
    kept, logits = {}, np.repeat(w["c"][None], n_t, 0)
    for d in "fb":
        E, U, W = w[f"E{d}"], w[f"U{d}"], w[f"W{d}"]
        h, steps = np.zeros((H, B), np.float32), []
        out = np.empty((n_t, len(net.labels), B), np.float32)
        for t in range(n_t) if d == "f" else range(n_t - 1, -1, -1):
            x, u = E[:, idx[t]], U @ h
            z, r = _sigmoid(x[:H] + u[:H]), _sigmoid(x[H : 2 * H] + u[H : 2 * H])
            n = np.tanh(x[2 * H :] + r * u[2 * H :])
            new = n + z * (h - n)
            steps.append((t, h, z, r, n, u[2 * H :], new))
            out[t] = W @ new
            h = new
        kept[d] = steps
        logits = logits + out
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    loss = -float(np.log(p[:, y, np.arange(B)] + 1e-9).mean())
    dl = p
    dl[:, y, np.arange(B)] -= 1
    dl /= n_t * B
    grad = {"c": dl.sum((0, 2))[:, None]}
    for d in "fb":
        U, W = w[f"U{d}"], w[f"W{d}"]
        dU, dW, dh = np.zeros_like(U), np.zeros_like(W), np.zeros((H, B), np.float32)
        dx = np.empty((3 * H, n_t, B), np.float32)
        for t, h, z, r, n, un, new in reversed(kept[d]):
            dW += dl[t] @ new.T
            dh = dh + W.T @ dl[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r])
            dx[:, t] = np.concatenate([dz, dr, dn])
            dU += du @ h.T
            dh = dh * z + U.T @ du
        flat = idx.ravel()
        grad[f"E{d}"] = np.stack([np.bincount(flat, row.ravel(), 257) for row in dx]).astype(np.float32)
        grad[f"U{d}"], grad[f"W{d}"] = dU, dW
    return loss, grad


def _noise(rng: np.random.Generator, length: int) -> np.ndarray:
    """Bytes of no language: symbols and digits, random letters, or characters from all over."""
    kind = rng.integers(3)
    if kind == 0:
        pool = np.frombuffer(b"0123456789!#$%&*+-/:;<=>?@[]^_{|}~.,() \n", np.uint8)
        return rng.choice(pool, length)
    if kind == 1:
        out = rng.choice(np.frombuffer(b"bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ0123456789", np.uint8), length)
        out[rng.random(length) < 0.1] = 32
        return out
    text = "".join(map(chr, rng.integers(0x370, 0xD000, length)))
    return np.frombuffer(text.encode(), np.uint8)[:length]


def train(rows: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> Network:
    """rows: (language, text). Rows without text are left out; with no rows, all texts are undetermined."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[np.ndarray]] = {}
    for lang, text in sorted((str(a), b) for a, b in rows if a and b):
        by.setdefault(lang, []).append(np.frombuffer(text.encode(), np.uint8))
    labels = [*sorted(by), UNDETERMINED]
    net = _start(labels, hidden, rng)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    for step in range(1, steps + 1 if by else 1):
        length = int(rng.integers(24, 80))
        idx = np.full((length, batch), _PAD, np.int64)
        y = rng.integers(len(labels), size=batch)
        for k, label in enumerate(y):
            if labels[label] == UNDETERMINED:
                x = _noise(rng, length)
            else:
                text = by[labels[label]][rng.integers(len(by[labels[label]]))]
                at = rng.integers(max(1, len(text) - length + 1))
                x = text[at : at + length]
            idx[: len(x), k] = x
        _, grad = _train_step(net, idx, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.03 * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.weights[k] = (net.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _segments(b: np.ndarray, offs: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, segments) byte values, short segments padded, and each row's first segment."""
    size = np.diff(offs)
    count = -(-size // segment)
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    idx = np.full((total, segment), _PAD, np.int64)
    base = int(offs[0])
    t = b[base : int(offs[-1])]
    row = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(t)) - (offs[row] - base)
    idx[first[row] + within // segment, within % segment] = t
    return np.ascontiguousarray(idx.T), first


def _probabilities(net: Network, idx: np.ndarray) -> np.ndarray:
    """(time, labels, batch) probabilities; a padded step leaves the state as it is."""
    H, (n_t, B), w, C = net.hidden, idx.shape, net.weights, len(net.labels)
    out = np.empty((n_t, C, B), np.float32)
    x, u = np.empty((3 * H, B), np.float32), np.empty((3 * H, B), np.float32)
    n, g = np.empty((H, B), np.float32), np.empty((C, B), np.float32)
    for d in "fb":
        E, U, W = w[f"E{d}"].copy(), w[f"U{d}"].copy(), w[f"W{d}"]
        E[:H, _PAD] = 40.0
        E[: 2 * H] *= 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        U[: 2 * H] *= 0.5
        h = np.zeros((H, B), np.float32)
        for t in range(n_t) if d == "f" else range(n_t - 1, -1, -1):
            np.take(E, idx[t], axis=1, out=x, mode="clip")
            np.matmul(U, h, out=u)
            a = x[: 2 * H]
            a += u[: 2 * H]
            np.tanh(a, out=a)
            a *= 0.5
            a += 0.5
            np.multiply(a[H:], u[2 * H :], out=n)
            n += x[2 * H :]
            np.tanh(n, out=n)
            h -= n
            h *= a[:H]
            h += n
            if d == "f":
                np.matmul(W, h, out=out[t])
            else:
                np.matmul(W, h, out=g)
                out[t] += g
    out += w["c"]
    np.exp(out, out=out)  # logits are small: weights and states are bounded
    out /= out.sum(1, keepdims=True)
    return out


def document_probabilities(net: Network, b: np.ndarray, offs: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(rows, labels) means over the bytes of each row, and counts of bytes by most probable label."""
    idx, first = _segments(b, offs, segment)
    rows, C = len(offs) - 1, len(net.labels)
    if not idx.shape[1]:
        return np.zeros((rows, C)), np.zeros((rows, C), np.int64)
    sums, tally = np.empty((C, idx.shape[1])), np.empty((C, idx.shape[1]), np.int64)
    p = _probabilities(net, idx)
    pad = idx == _PAD
    p *= ~pad[:, None, :]
    best = np.where(pad, -1, p.argmax(1))
    np.sum(p, axis=0, dtype=np.float64, out=sums)
    for k in range(C):
        tally[k] = (best == k).sum(0)

    def by_row(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((C, 1), x.dtype), np.cumsum(x, 1)], 1)
        return (total[:, first[1:]] - total[:, first[:-1]]).T

    return by_row(sums) / np.maximum(np.diff(offs), 1)[:, None], by_row(tally)


def _decide(p: np.ndarray, size: np.ndarray, reject: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is accepted, and the number of its label."""
    und = p.shape[1] - 1
    ok = (size > 0) & (p[:, und] < reject) & (und > 0)
    return ok, np.where(ok, p[:, :und].argmax(1) if und else 0, und)


def label_positions(net: Network, text: str | None, segment: int = SEGMENT) -> list[str]:
    """The most probable label of every UTF-8 byte of a text."""
    raw = (text or "").encode()
    idx, _ = _segments(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), segment)
    if not raw:
        return []
    best = _probabilities(net, idx).argmax(1).T.ravel()[: len(raw)]
    return [net.labels[k] for k in best]


def labelled_sample(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(lang, text) of the documents of least hash of each language."""
    d = pick(docs, doc_id="long", lang="string", text="string").where("lang is not null and text is not null and doc_id is not null and lang <> ''")
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = d.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows_per_language)
    chosen = [r.doc_id for r in ids.select("doc_id").distinct().collect()]
    found = d.where(F.col("doc_id").isin(chosen)).select("lang", "text").collect() if chosen else []
    return [(r.lang, r.text) for r in found]


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, **how) -> Network:
    return train(labelled_sample(docs, rows_per_language), **how)


_OUT = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("probability", pa.float64()), ("positions", pa.int64()), ("label_counts", pa.map_(pa.string(), pa.int64())), ("accepted", pa.bool_())])
_OUT_DDL = "doc_id long, language string, probability double, positions long, label_counts map<string,long>, accepted boolean"


def _classify(net: Network, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By row range: sizes, probabilities, byte counts."""
    b, offs = buffers(column)
    for i, j in slices(offs, _BYTES):
        p, tally = document_probabilities(net, b, offs[i : j + 1])
        yield i, j, np.diff(offs[i : j + 1]), p, tally


def identify(docs: DataFrame, net: Network | None = None, reject: float = REJECT) -> DataFrame:
    """(doc_id, language, probability, positions, label_counts, accepted) of every row.

    positions counts the UTF-8 bytes, all of which are labelled; label_counts has them by label. Accepted are
    documents with a probability of "und" under `reject`; their language is the likeliest one, others' is "und". A null
    or empty text has a null language, probability 0 and is not accepted. Ties go to the first label in alphabetical order. Without a network one is fitted on docs' own lang.
    Repeated rows give repeated results, null ids stay null; other columns are ignored.
    """
    net = net or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, size, p, tally in _classify(net, batch.column(1)):
                ok, best = _decide(p, size, reject)
                names = pa.array([net.labels[k] if n else None for k, n in zip(best, size)], pa.string())
                prob = pa.array(np.where(size > 0, np.round(p[np.arange(j - i), best], 4), 0.0))
                keys = pa.array(net.labels * (j - i), pa.string())
                counts = pa.MapArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(net.labels)), keys, pa.array(tally.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), names, prob, pa.array(size), counts, pa.array(ok)], schema=_OUT)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, _OUT_DDL)


def keep_accepted(docs: DataFrame, net: Network | None = None, reject: float = REJECT, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that identify() accepts. No shuffle.

    Rows of null or empty text go, null ids stay, repeated rows fare alike, and an empty table stays empty.
    """
    net = net or fit(docs)
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, j, size, p, _ in _classify(net, batch.column(at)):
                ok[i:j] = _decide(p, size, reject)[0]
            yield batch.filter(pa.array(ok))

    # Arrow columns are matched by place, so clashing names do no harm inside; they are restored after
    plain = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    inner = T.StructType([T.StructField(f"_{k}", f.dataType, True) for k, f in enumerate(schema.fields)])
    return plain.mapInArrow(run, inner).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
