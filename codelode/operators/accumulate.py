"""Term-at-a-time scoring in blocks: chunks stay where they are, the questions' terms go to them, and only the best of each task leave it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Contributions, and cells of chunks by questions, of a block.
CONTRIBUTIONS, CELLS = 2_000_000, 4_000_000


def _counter(terms, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(terms.value, pa.string())
        for batch in batches:
            n, keys = batch.num_rows, []
            for f in fields:
                col = batch.column(batch.schema.get_field_index(f"t_{f}"))
                at = pc.fill_null(pc.index_in(col.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), pc.list_value_length(col).to_numpy(zero_copy_only=False))
                keys.append(np.unique((row * max(1, len(values)) + at)[at >= 0], return_counts=True))
            every = np.unique(np.concatenate([k for k, _ in keys]))
            row, t = np.divmod(every, max(1, len(values)))
            offs = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
            out = [batch.column(0), batch.column(1).cast(pa.int64()), pa.ListArray.from_arrays(offs, pa.array(t.astype(np.int32)))]
            for k, c in keys:
                f = np.zeros(len(every), np.int32)
                f[np.searchsorted(every, k)] = c
                out.append(pa.ListArray.from_arrays(offs, pa.array(f)))
            yield pa.RecordBatch.from_arrays(out, names=["chunk_id", "dl", "t", *[f"f_{x}" for x in fields]])

    return run


def counted(toks: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """(chunk_id, dl, t, f_<field>...) of toks (chunk_id, dl, t_<field>...): the places among terms of those that a chunk has, and how often each field has them. Written; no token is shuffled."""
    kind = dict(toks.dtypes)["chunk_id"]
    sent = toks.sparkSession.sparkContext.broadcast(terms)
    x = toks.select("chunk_id", "dl", *[f"t_{f}" for f in fields])
    return materialize(x.mapInArrow(_counter(sent, fields), f"chunk_id {kind}, dl long, t array<int>, " + ", ".join(f"f_{f} array<int>" for f in fields)), "counted")


class _Best:
    """The k best chunks of every question so far, by score to six decimals and id."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.rows = k, np.full(n, -np.inf), None

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        up = score >= self.least[q]
        q, ids, score = q[up], ids[up], score[up]
        if not len(q):
            return
        y = np.abs(score) * 1e6
        whole = np.rint(y)
        score = np.copysign((whole + (y - whole == 0.5)) / 1e6, score)
        if self.rows is not None:
            q, ids, score = (np.concatenate(x) for x in zip(self.rows, (q, ids, score)))
        by = ids if ids.dtype != object else np.unique(ids.astype(str), return_inverse=True)[1]
        o = np.lexsort((by, -score, q))
        q, ids, score = q[o], ids[o], score[o]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = score[last] - 1e-6
        keep = place < self.k
        self.rows = q[keep], ids[keep], score[keep]


def _scorer(sent, fields: list[str], k: int, types: list[pa.DataType]):
    """sent: what scoring() makes of the questions; rows out are (query_id, chunk_id, stage, score), for stages also the numbers of chunks that reach each (chunk_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        ids, ptr, qi, w, idf, n, mode, avg = (s[x] for x in ("ids", "ptr", "q", "w", "idf", "n", "mode", "avg"))
        size = len(ids)
        best = {g: _Best(size, k) for g in ((1, 2, 3, 4) if mode == "stages" else (4,))}
        reach = {g: np.zeros(size, np.int64) for g in best}

        def score(chunk: np.ndarray, dl: np.ndarray, row: np.ndarray, t: np.ndarray, f: list[np.ndarray]) -> None:
            c = ptr[t + 1] - ptr[t]
            rep = np.repeat(np.arange(len(t)), c)
            at = np.arange(len(rep)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(ptr[t], c)
            q, own = qi[at], row[rep]
            tf = sum(w[i][at] * f[i][rep] for i in range(len(fields)))
            if mode == "dot":
                x = np.log1p(f[0])[rep] * w[0][at]
            else:
                x = idf[t][rep] * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl[own] / avg))
            cell = own * size + q
            if mode == "stages":
                o = np.lexsort((x, cell))
                cell, x = cell[o], x[o]
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                m = np.diff(np.append(first, len(cell)))
                total, last = np.add.reduceat(x, first), first + m - 1
                who, query = np.divmod(cell[first], size)
                two = np.where(m >= 2, x[last] + x[np.maximum(last - 1, 0)], np.nan)
                nn = n[query]
                s1 = np.where((nn > 1) & (m == nn), total, np.nan)
                s2 = np.where(nn >= 3, np.where(m == nn, total - x[first], np.where(m == nn - 1, total, np.nan)), np.nan)
                s3 = np.where(nn >= 4, np.fmax(s2, two), np.nan)
                for g, y in ((1, s1), (2, s2), (3, s3), (4, total)):
                    has = ~np.isnan(y)
                    reach[g] += np.bincount(query[has], minlength=size)
                    best[g].add(query[has], chunk[who[has]], y[has])
                return
            total, m = np.bincount(cell, x, len(chunk) * size), np.bincount(cell, minlength=len(chunk) * size)
            floor = np.tile(best[4].least, len(chunk))
            at = np.flatnonzero((m > 0) & (total >= floor) & ((m == np.tile(n, len(chunk))) if mode == "all" else True))
            best[4].add(at % size, chunk[at // size], total[at])

        for batch in batches if size else ():
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            dl = batch.column(1).to_numpy()
            offs = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))])
            t = batch.column(2).flatten().to_numpy()
            f = [batch.column(3 + i).flatten().to_numpy().astype(float) for i in range(len(fields))]
            made = np.concatenate([[0], np.cumsum(ptr[t + 1] - ptr[t])])[offs]
            i = 0
            while i < len(chunk):
                j = min(len(chunk), i + max(1, CELLS // size), max(i + 1, int(np.searchsorted(made, made[i] + CONTRIBUTIONS, "right")) - 1))
                a, b = offs[i], offs[j]
                if made[j] > made[i]:
                    score(chunk[i:j], dl[i:j], np.repeat(np.arange(j - i), np.diff(offs[i : j + 1])), t[a:b], [x[a:b] for x in f])
                i = j
        names = ["query_id", "chunk_id", "stage", "score"]
        for g, x in best.items():
            if x.rows is not None:
                q, c, y = x.rows
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], types[0]), pa.array(c.tolist(), types[1]), pa.array(np.full(len(q), g, np.int32)), pa.array(y)], names=names)
            if mode == "stages" and reach[g].any():
                q = np.flatnonzero(reach[g])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], types[0]), pa.nulls(len(q), types[1]), pa.array(np.full(len(q), g, np.int32)), pa.array(reach[g][q].astype(float))], names=names)

    return run


#: Types of ids.
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def scores(found: DataFrame, phrases: list, terms: list[str], weights: list[str], fields: list[str], k: int, mode: str, kinds: tuple[str, str], n_all: int = 0, avg: float = 1.0, freq: dict | None = None) -> DataFrame:
    """(query_id, chunk_id, stage, score): at least the k best chunks of each question; found as of counted().

    phrases: rows of query_id, n, term and the columns `weights`, one for each field. mode: "sum" of BM25 contributions, of chunks that have "all"
    terms, "stages" as graduated matching has them, "dot" for sums of log(1 + frequency) times the weight.
    """
    place = {t: i for i, t in enumerate(terms)}
    ids = list(dict.fromkeys(r["query_id"] for r in phrases))
    of = {x: i for i, x in enumerate(ids)}
    rows = [r for r in phrases if r["term"] in place]
    t = np.array([place[r["term"]] for r in rows], np.int64)
    o = np.argsort(t, kind="stable")
    n = np.zeros(len(ids), np.int64)
    for r in phrases:
        n[of[r["query_id"]]] = r["n"]
    df = np.array([(freq or {}).get(i, 0) for i in range(len(terms))], float)
    idf = np.log((n_all - df + 0.5) / (df + 0.5)) if mode != "dot" else df
    sent = {
        "ids": ids, "ptr": np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(terms)))]).astype(np.int64), "q": np.array([of[r["query_id"]] for r in rows], np.int64)[o],
        "w": [np.array([r[c] for r in rows], float)[o] for c in weights], "idf": np.where(idf > 0, idf, 1e-6), "n": n, "mode": mode, "avg": avg,
    }
    send = found.sparkSession.sparkContext.broadcast(sent)
    return found.mapInArrow(_scorer(send, fields, k, [KINDS[x] for x in kinds]), f"query_id {kinds[0]}, chunk_id {kinds[1]}, stage int, score double")
