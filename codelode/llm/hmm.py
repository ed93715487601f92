"""Operator 9: language-model scores by a hidden Markov model over words.

Symbols are the VOCABULARY most frequent words of the corpus, counted over all documents, and OTHERS classes (by hash)
for the rest; within its class a word of the rest has the share of its own count over all documents, from a distributed
table. What states say of such words is learned by class. The model is trained by ROUNDS of Baum-Welch over every word of every document: each partition runs the
scaled forward and backward recursions over its texts and returns expected counts by
blocks of symbols; these are added up across partitions, and the sums make the next model. Scoring is the scaled forward
recursion over each whole document, from its first word to its last, so the likelihood of the sequence is exact.

Sequences are whole ones. To work on many words at a time, long ones are divided into stretches of SEGMENT words, all of which advance together; the products of
their transition matrices carry the forward and backward vectors over the borders, so the division changes nothing but rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick
from .textops import buffers, lists, mix64, slices, words

STATES = 6
VOCABULARY = 1 << 16
OTHERS = 256
ROUNDS = 3
SEGMENT = 256
#: Words handled at once.
_BATCH = 1 << 19
#: Symbols by block of expected counts.
_BLOCK = 4096


@dataclass
class Model:
    vocabulary: np.ndarray  # ascending word hashes
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states), each column adding up to 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, size): a task's words with their counts and lengths in bytes."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def merge() -> None:
        w, n, z = (np.concatenate(x) for x in zip(*held))
        u, at = np.unique(w, return_index=True)
        held[:] = [(u, np.bincount(np.searchsorted(u, w), n).astype(np.int64), z[at])]

    for batch in batches:
        b, offs = buffers(batch.column(0))
        for i, j in slices(offs):
            h, s, e, _ = words(b, offs[i : j + 1])
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, n, (e - s)[at]))
            rows += len(u)
            if rows > 2_000_000:
                merge()
                rows = len(held[0][0])
    if held:
        merge()
        w, n, z = held[0]
        for k in range(0, len(w), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(w[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000]), pa.array(z[k : k + 100_000])], names=["word", "n", "size"])


def symbols(h: np.ndarray, vocabulary: np.ndarray, others: int = OTHERS) -> np.ndarray:
    """Symbol numbers of word hashes: places in the vocabulary, then the classes of other words."""
    v = len(vocabulary)
    out = (v + (h % np.uint64(others)).astype(np.int64)).astype(np.int32)
    if v:
        k = np.minimum(np.searchsorted(vocabulary, h), v - 1)
        known = vocabulary[k] == h
        out[known] = k[known]
    return out


def _to_symbols(vocabulary: np.ndarray, others: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            b, offs = buffers(batch.column(1))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for i, j in slices(offs):
                h, _, _, first = words(b, offs[i : j + 1])
                which = symbols(h, vocabulary, others)
                syms = lists(which, first, pa.int32())
                rare = which >= len(vocabulary)
                tail = lists(h[rare].view(np.int64), np.concatenate([[0], np.cumsum(rare)])[first], pa.int64())
                if null[i:j].any():
                    syms = pa.array([None if x else y for x, y in zip(null[i:j], syms.to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i), syms, tail], names=["row", "doc_id", "symbols", "tail"])
                row += j - i

    return run


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest sequences first: their order, how many are active at each step, and where each step begins."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(lengths) else 0
    active = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")
    return order, active, np.concatenate([[0], np.cumsum(active)])


@dataclass
class _Stretches:
    """Sequences cut into stretches, with the vectors at their borders."""

    first: np.ndarray  # borders of the stretches
    of: np.ndarray  # the sequence of each
    enter: np.ndarray  # (stretches, states): the distribution before a stretch's first word
    leave: np.ndarray  # (stretches, states): how likely what follows is, up to a factor


def _stretches(m: Model, flat: np.ndarray, first: np.ndarray, segment: int, backward: bool) -> _Stretches:
    K = len(m.start)
    n = np.diff(first)
    parts = -(-n // segment)
    borders = _segmented(first, segment)
    of = np.repeat(np.arange(len(n)), parts)
    S = len(of)
    place = np.arange(S) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
    last = place == parts[of] - 1
    enter, leave = np.repeat(m.start[None], S, 0), np.ones((S, K))
    inner = np.flatnonzero(~last)
    if not len(inner):
        return _Stretches(borders, of, enter, leave)
    # products of (emission, move) over the stretches that another follows, which are all of `segment` words
    X = np.repeat(np.eye(K)[None], len(inner), 0)
    P = None
    head = borders[inner]
    for t in range(segment):
        P = X * m.emit[flat[head + t]][:, None, :]
        P /= P.sum((1, 2))[:, None, None]
        X = (P.reshape(-1, K) @ m.move).reshape(-1, K, K)
    at = np.full(S, -1)
    at[inner] = np.arange(len(inner))
    by = [inner[place[inner] == d] for d in range(int(place.max()))]
    for k in by:
        x = np.einsum("nk,nkj->nj", enter[k], X[at[k]])
        enter[k + 1] = x / x.sum(1, keepdims=True)
    if backward:
        # what the last stretches say of their beginnings
        tail = np.flatnonzero(last & (place > 0))
        order, active, _ = _layout(np.diff(borders)[tail])
        z = np.ones((len(tail), K))
        head = borders[tail][order]
        for t in range(len(active) - 1, 0, -1):
            c = int(active[t])
            y = (m.emit[flat[head[:c] + t]] * z[:c]) @ m.move.T
            z[:c] = y / y.sum(1, keepdims=True)
        z *= m.emit[flat[head]]
        begin = np.zeros((S, K))
        begin[tail[order]] = z
        for k in reversed(by):
            x = begin[k + 1] @ m.move.T
            leave[k] = x / x.sum(1, keepdims=True)
            begin[k] = np.einsum("nkj,nj->nk", P[at[k]], leave[k])
            begin[k] /= begin[k].sum(1, keepdims=True)
    return _Stretches(borders, of, enter, leave)


def log_likelihoods(m: Model, flat: np.ndarray, first: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Of each sequence flat[first[k]:first[k + 1]]; 0 for an empty one."""
    s = _stretches(m, flat, first, segment, False)
    order, active, _ = _layout(np.diff(s.first))
    head = s.first[:-1][order]
    total = np.zeros(len(order))
    a = s.enter[order]
    for t, n in enumerate(active.tolist()):
        a = (a[:n] if not t else a[:n] @ m.move) * m.emit[flat[head[:n] + t]]
        c = a.sum(1)
        total[:n] += np.log(c)
        a /= c[:, None]
    return np.bincount(s.of[order], total, len(first) - 1)


def expected_counts(m: Model, flat: np.ndarray, first: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log likelihood, of sequences."""
    S, K = m.emit.shape
    cut = _stretches(m, flat, first, segment, True)
    order, active, at = _layout(np.diff(cut.first))
    head = cut.first[:-1][order]
    syms = np.empty(at[-1], np.int64)
    for t, n in enumerate(active.tolist()):
        syms[at[t] : at[t + 1]] = flat[head[:n] + t]
    E = m.emit[syms].astype(np.float32)
    A = m.move.astype(np.float32)
    alpha, c = np.empty_like(E), np.empty(len(E), np.float32)
    enter, beta = cut.enter[order].astype(np.float32), cut.leave[order].astype(np.float32)
    end = np.empty((len(order), K), np.float32)
    for t, n in enumerate(active.tolist()):
        now = slice(at[t], at[t + 1])
        a = alpha[now]
        if t:
            np.matmul(alpha[at[t - 1] : at[t - 1] + n], A, out=a)
            a *= E[now]
        else:
            np.multiply(enter[:n], E[now], out=a)
        a.sum(1, out=c[now])
        a /= c[now][:, None]
        end[:n] = a
    ll = float(np.log(c.astype(float)).sum())
    moves = np.zeros((K, K))
    beta /= (end * beta).sum(1)[:, None]
    for t in range(len(active) - 1, 0, -1):
        n = int(active[t])
        now = slice(at[t], at[t + 1])
        x = E[now] * beta[:n]
        x /= c[now][:, None]
        before = alpha[at[t - 1] : at[t - 1] + n]
        moves += before.T @ x
        alpha[now] *= beta[:n]  # from here on the posterior of this step
        beta[:n] = x @ A.T
    starts = np.zeros(K)
    if len(active):
        opening = alpha[: at[1]]
        x = E[: at[1]] * beta / c[: at[1]][:, None]
        opening *= beta
        # moves over the borders; a sequence's other stretches follow it
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        follows = np.flatnonzero(np.concatenate([[False], cut.of[1:] == cut.of[:-1]]))
        moves += end[where[follows - 1]].T @ x[where[follows]]
        begins = np.ones(len(order), bool)
        begins[follows] = False
        starts = opening[where[begins]].sum(0, dtype=float)
    emissions = np.stack([np.bincount(syms, alpha[:, k], S) for k in range(K)], 1)
    return starts, moves * m.move, emissions, ll


def _segmented(first: np.ndarray, segment: int) -> np.ndarray:
    """Sequence borders cut every `segment` words."""
    n = np.diff(first)
    parts = np.maximum(-(-n // segment), 0)
    k = np.arange(parts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
    return np.append(np.repeat(first[:-1], parts) + k * segment, first[-1])


def _batches(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about _BATCH symbols, with their symbols and borders."""
    offs = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy()
    for i, j in slices(offs, _BATCH):
        yield i, j, flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _expect(model, segment: int):
    """A task's expected counts: block -1 holds starts, moves and log likelihood, the others _BLOCK symbols' emissions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        K = len(m.start)
        starts, moves, emissions, ll, some = np.zeros(K), np.zeros((K, K)), np.zeros(m.emit.shape), 0.0, False
        for batch in batches:
            for _, _, flat, first in _batches(batch.column(0)):
                if len(flat):
                    some = True
                    s, mv, e, x = expected_counts(m, flat, first, segment)
                    starts += s
                    moves += mv
                    emissions += e
                    ll += x
        if some:
            rows = [(-1, np.concatenate([starts, moves.ravel(), [ll]]).tobytes())]
            rows += [(k, emissions[k * _BLOCK : (k + 1) * _BLOCK].tobytes()) for k in range(-(-len(emissions) // _BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(raw)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def first_model(vocabulary: np.ndarray, counts: np.ndarray, sizes: np.ndarray, rest: float, states: int, others: int) -> Model:
    """States begin as classes of word lengths, with a seeded disturbance, and soft."""
    n = np.concatenate([counts.astype(float), np.full(others, max(rest, 1.0) / others)])
    rank = np.concatenate([np.minimum(np.searchsorted(np.array([1, 2, 4, 7, 10]), sizes, "left"), states - 1), np.full(others, states - 1)]) % states
    ids = np.concatenate([vocabulary, np.arange(others, dtype=np.uint64)])
    noise = np.stack([mix64(ids + np.uint64(k + 1)).astype(float) / 2.0**64 for k in range(states)], 1)
    emit = n[:, None] * (0.2 + 0.2 * noise + (rank[:, None] == np.arange(states)[None]))
    emit /= emit.sum(0)
    move = np.full((states, states), 1 / states) + 0.2 * np.eye(states)
    return Model(vocabulary, np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit)


def maximize(m: Model, starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> Model:
    """The next model; a little of the overall distribution keeps every symbol possible in every state."""
    s = starts + 0.1
    mv = moves + 0.1
    over = emissions.sum(1) + 0.5
    e = emissions + 2.0 * (over / over.sum())[:, None]
    return Model(m.vocabulary, s / s.sum(), mv / mv.sum(1, keepdims=True), e / e.sum(0))


def train(docs: DataFrame, states: int = STATES, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, segment: int = SEGMENT, others: int = OTHERS) -> tuple[Model, DataFrame, list[float]]:
    """The model, the documents as symbols, and the log likelihood before each round. Words within their class are left out of both."""
    return _train(docs, states, vocabulary, rounds, segment, others)[:3]


def _shares(counted: DataFrame, top: pa.Table, others: int) -> DataFrame:
    """(word, share) of the words that are not in the vocabulary: the logarithm of a word's part in its class."""
    rest = counted
    if top.num_rows:
        n, word = top["n"][-1].as_py(), top["word"][-1].as_py()
        rest = counted.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word)))
    # as an unsigned number
    of = F.pmod(F.pmod("word", F.lit(others)) + F.when(F.col("word") < 0, F.lit((1 << 64) % others)).otherwise(F.lit(0)), F.lit(others))
    rest = rest.select("word", "n", of.alias("class"))
    whole = F.broadcast(rest.groupBy("class").agg(F.sum("n").alias("whole")))  # at most `others` rows
    return rest.join(whole, "class").select("word", F.log(F.col("n") / F.col("whole")).alias("share"))


def _train(docs: DataFrame, states: int = STATES, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, segment: int = SEGMENT, others: int = OTHERS) -> tuple[Model, DataFrame, list[float], DataFrame]:
    """As train(), and the shares of the words that are not in the vocabulary."""
    spark = docs.sparkSession
    d = pick(docs, doc_id="long", text="string")
    counted = materialize(d.where("text is not null").select("text").mapInArrow(_count_words, "word long, n long, size long").groupBy("word").agg(F.sum("n").alias("n"), F.max("size").alias("size")), "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counted.orderBy(F.col("n").desc(), "word").limit(vocabulary).toArrow()
    w = top["word"].to_numpy().view(np.uint64)
    o = np.argsort(w)
    counts, sizes = top["n"].to_numpy()[o], top["size"].to_numpy()[o]
    model = first_model(w[o], counts, sizes, float(total - counts.sum()), states, others)
    rows = materialize(d.mapInArrow(_to_symbols(model.vocabulary, others), "row long, doc_id long, symbols array<int>, tail array<long>"), "symbols")
    heard = []
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)  # of fixed size: vocabulary x states
        parts = rows.where("symbols is not null").select("symbols").mapInArrow(_expect(sent, segment), "block int, counts binary")
        got = {r["block"]: np.frombuffer(bytes(r["counts"])) for r in parts.repartition("block").mapInArrow(_add_up, "block int, counts binary").collect()}
        sent.unpersist()
        if not got:
            break
        k = states
        head = got.pop(-1)
        heard.append(float(head[-1]))
        emissions = np.concatenate([got[b] for b in sorted(got)]).reshape(-1, k)
        model = maximize(model, head[:k], head[k : k + k * k].reshape(k, k), emissions)
    return model, rows, heard, _shares(counted, top, others)


_OUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_likelihood", pa.float64())])


def score_symbols(rows: DataFrame, model: Model, shares: DataFrame | None = None) -> DataFrame:
    """Scores of the symbols; with shares, of the words themselves."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            valid = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for i, j, flat, first in _batches(batch.column(2)):
                ll, n, ok = log_likelihoods(m, flat, first), np.diff(first), valid[i:j]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, mask=~ok), pa.array(ll, mask=~ok)], schema=_OUT)

    out = rows.select("row", "doc_id", "symbols").mapInArrow(run, "row long, doc_id long, n_words long, log_likelihood double")
    ll = F.col("log_likelihood")
    if shares is not None:
        words = rows.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
        out = out.join(words.join(shares, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("share")).alias("inside")), "row", "left")
        ll = ll + F.coalesce("inside", F.lit(0.0))
    return out.select("doc_id", "n_words", F.round(ll, 4).alias("log_likelihood"), F.when(F.col("n_words") > 0, F.round(F.exp(-ll / F.col("n_words")), 4)).alias("perplexity"))


def score_documents(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) of every row under a model trained on all of docs.

    A null text has nulls; a text without words 0 words, likelihood 0 and a null perplexity. Null ids stay null,
    repeated rows count and are scored as often as they occur, other columns are ignored; an empty table gives no rows.
    """
    model, rows, _, shares = _train(docs, **how)
    return score_symbols(rows, model, shares)


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
