"""Dense vectors: exact nearest neighbours, reranking, scalar quantization. Sparse vectors: inverted dot products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Vectors by block of the exact search, and blocks that a task holds.
BLOCK, HELD = 2048, 64
#: Groups up to which their sizes are broadcast.
BROADCAST_GROUPS = 1_000_000
FLOOR = 1e-9


def dot(a: Column, b: Column) -> Column:
    """A dot product in the order of the dimensions."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    n = F.greatest(F.lit(FLOOR), F.sqrt(dot(v, v)))
    return F.transform(v.cast("array<double>"), lambda x: x / n)


def _blocks(v: DataFrame, prefix: str, block: int) -> DataFrame:
    """v (g, id, v) in rows of about `block` vectors of one g and one dimension."""
    v = v.where("size(v) > 0")
    size = v.groupBy("g").agg(F.ceil(F.count("*") / block).alias("n"))
    at = v.join(F.broadcast(size) if size.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else size, "g").withColumn("b", F.expr("pmod(xxhash64(id), n)"))
    return at.groupBy(F.col("g").alias(f"{prefix}_g"), F.size("v").alias(f"{prefix}_dim"), F.col("b").alias(f"{prefix}_block")).agg(F.collect_list("id").alias(f"{prefix}_ids"), F.flatten(F.collect_list("v")).alias(f"{prefix}_v"))


def _block_top(k: int, same: bool, positive: bool):
    """Rows pair a block of queries with one of vectors. While the block of queries stays, a score counts only if it may come before the k best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = qi = q = least = best = None

        def out() -> pa.RecordBatch:
            row, ids, score = best
            return pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])

        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in ("q_g", "q_block", "q_ids", "q_v", "q_dim", "d_ids", "d_v")}
            for r in range(batch.num_rows):
                dim = cols["q_dim"][r].as_py()
                if (now := (cols["q_g"][r].as_py(), cols["q_block"][r].as_py(), dim)) != key:
                    if key is not None:
                        yield out()
                    key = now
                    qi, q = cols["q_ids"][r].values.to_numpy(), cols["q_v"][r].values.to_numpy().reshape(-1, dim)
                    least = None
                    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                di, d = cols["d_ids"][r].values.to_numpy(), cols["d_v"][r].values.to_numpy().reshape(-1, dim)
                s = q @ d.T
                if least is None:
                    # the first block sets a bound: the k-th of its scores, which rounding may move
                    x = np.where(np.isnan(s), -np.inf, s)
                    if same:
                        x[qi[:, None] == di[None, :]] = -np.inf
                    least = np.partition(x, -k, axis=1)[:, -k] - 1e-6 if x.shape[1] >= k else np.full(len(qi), -np.inf)
                    if positive:
                        least = np.maximum(least, 0)
                row, col = np.nonzero(s >= least[:, None])
                if same:
                    other = qi[row] != di[col]
                    row, col = row[other], col[other]
                # to six decimals, halves away from zero
                y = np.abs(s[row, col]) * 1e6
                whole = np.rint(y)
                score = np.copysign((whole + (y - whole == 0.5)) / 1e6, s[row, col])
                if positive:
                    up = score > 0
                    row, col, score = row[up], col[up], score[up]
                row, ids, score = np.concatenate([best[0], row]), np.concatenate([best[1], di[col]]), np.concatenate([best[2], score])
                # equal scores go by id, so the order is by both
                o = np.lexsort((ids, -score, row))
                row, ids, score = row[o], ids[o], score[o]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                last = place == k - 1
                least[row[last]] = np.maximum(least[row[last]], score[last] - 1e-6)
                best = row[place < k], ids[place < k], score[place < k]
        if key is not None:
            yield out()

    return run


def _top(vectors: DataFrame, queries: DataFrame, k: int, skip_same: bool, positive: bool, block: int) -> DataFrame:
    """(query_id, id, score, rank): the k best vectors of its own g for every query; both (g, id, v)."""
    spark = vectors.sparkSession
    prep = lambda x: x.select("g", F.col("id").cast("long"), F.col("v").cast("array<double>"))
    d, q = materialize(_blocks(prep(vectors), "d", block), "blocks"), materialize(_blocks(prep(queries), "q", block), "queries")
    n_d, n_q = max(1, d.count()), max(1, q.count())
    # tasks hold HELD blocks of vectors and pass blocks of queries by them, each one's pairs in a row
    d, q = d.repartition(-(-n_d // HELD)), q.repartition(max(1, min(n_q, 4 * spark.sparkContext.defaultParallelism)))
    # no equality that a join could gather one g's blocks in one task for
    near = q.crossJoin(d).where("q_dim <= d_dim and q_dim >= d_dim and q_g <= d_g and q_g >= d_g").select("q_g", "q_block", "q_ids", "q_v", "q_dim", "d_ids", "d_v").mapInArrow(_block_top(k, skip_same, positive), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 30, skip_same: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k rows of highest positive dot product, to six decimals, for every query.

    vectors and queries: id (long), v (array). Blocks of queries meet blocks of vectors, each pair is one matrix product
    of which only scores that come before the k best so far are looked at; the rest is a merge. Work is the product of both numbers.
    """
    one = lambda x: x.select(F.lit("").alias("g"), "id", "v")
    return _top(one(vectors), one(queries), k, skip_same, True, block)


def rerank_within(vectors: DataFrame, k: int = 50, block: int = BLOCK) -> DataFrame:
    """rerank() of all vectors (g, id, v) against all others of the same g, by blocks: no pair of candidates is written down."""
    unit = vectors.select("g", "id", normalize(F.col("v")).alias("v")).where("g is not null")
    return _top(unit, unit, k, True, False, block)


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, id, score, rank): candidates (query_id, id) by cosine; those without a vector go."""
    q = queries.select(F.col("id").alias("query_id"), normalize(F.col("v")).alias("qv"))
    d = vectors.select("id", normalize(F.col("v")).alias("dv"))
    s = candidates.select("query_id", "id").distinct().join(q, "query_id").join(d, "id").select("query_id", "id", F.round(dot(F.col("qv"), F.col("dv")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_topk(documents: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank): sums of products over shared terms.

    documents (chunk_id, term, weight) and queries (query_id, term, weight) are exploded sparse vectors.
    """
    q = queries.withColumnRenamed("weight", "q_weight")
    s = documents.join(q, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("q_weight")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_activation(logits: Column) -> Column:
    """The weight of a term from its scores at each position: the largest log(1 + max(0, x))."""
    return F.array_max(F.transform(logits, lambda x: F.log1p(F.greatest(F.lit(0.0), x))))


# scalar quantization


def codes(v: Column, bits: int = 4) -> Column:
    """struct(norm, lo, span, codes) of a vector: each component's place between the least and the greatest one, in 2^bits steps."""
    levels = 1 << bits
    x = v.cast("array<double>")
    lo = F.array_min(x)
    span = F.greatest(F.lit(1e-10), F.array_max(x) - lo)
    step = F.transform(x, lambda y: F.least(F.lit(levels - 1), F.greatest(F.lit(0), (F.ceil((y - lo) / span * levels) - 1).cast("int"))))
    return F.struct(F.sqrt(dot(v, v)).alias("norm"), lo.alias("lo"), span.alias("span"), step.alias("codes"))


def decode(q: Column, bits: int = 4) -> Column:
    """The vector that codes() stands for: the middle of each step."""
    return F.transform(q["codes"], lambda c: (c + 0.5) / (1 << bits) * q["span"] + q["lo"])


def pack(step: Column, bits: int = 4) -> Column:
    """Codes as bytes (array of 0 to 255), the first code in the lowest bits; a last group is filled with zeros."""
    per = 8 // bits
    groups = F.sequence(F.lit(0), F.ceil(F.size(step) / per).cast("int") - 1)
    return F.when(F.size(step) == 0, F.array().cast("array<int>")).otherwise(F.transform(groups, lambda g: sum((F.coalesce(F.get(step, (g * per + j).cast("int")), F.lit(0)) * (1 << (bits * j)) for j in range(per)), F.lit(0)).cast("int")))


def unpack(packed: Column, dim: Column, bits: int = 4) -> Column:
    per, levels = 8 // bits, 1 << bits
    flat = F.flatten(F.transform(packed, lambda b: F.array(*[(F.floor(b / (levels**j)) % levels).cast("int") for j in range(per)])))
    return F.slice(flat, F.lit(1), dim)


def storage_bytes(n: int, dim: int, bits: int = 4) -> int:
    return n * (-(-dim * bits // 8) + 12)


def compression_ratio(dim: int, bits: int = 4) -> float:
    return 4 * dim / (storage_bytes(1, dim, bits))


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix: the Q of a Gaussian matrix, with R's diagonal made positive."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(vectors: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """vectors (id, v) after one fixed rotation, which evens out the components before they are quantized. dim x dim numbers are sent to each task."""
    turn = rotation(dim, seed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["v"].to_numpy()).astype(float) @ turn.T if len(f) else np.zeros((0, dim))
            yield pd.DataFrame({"id": f["id"], "v": list(x)})

    return vectors.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInPandas(run, "id long, v array<double>")


def quantized_topk(vectors: DataFrame, queries: DataFrame, k: int = 30, bits: int = 4, turn: tuple[int, int] | None = None, skip_same: bool = False) -> DataFrame:
    """exact_topk() of whole-precision queries on quantized vectors; turn=(dim, seed) rotates both first."""
    if turn:
        vectors, queries = rotated(vectors, *turn), rotated(queries, *turn)
    stored = vectors.select("id", codes(F.col("v"), bits).alias("q"))
    return exact_topk(stored.select("id", decode(F.col("q"), bits).alias("v")), queries, k, skip_same)


Embedder = Callable[[list[str]], np.ndarray]
EMBEDDERS: dict[str, Callable[[], Embedder]] = {}


def register_embedder(name: str, make: Callable[[], Embedder]) -> None:
    """make() is called once in each Python worker, so it may load a model."""
    EMBEDDERS[name] = make


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed feature hashing of words."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for r, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[r, h % dim] += 1 if h >> 31 else -1
        return out

    return run


register_embedder("hashing", hashing_embedder)


def embed(texts: DataFrame, embedder: str = "hashing") -> DataFrame:
    """(id, v) of texts (id, text), unit vectors, in Arrow batches."""
    if embedder not in EMBEDDERS:
        raise ValueError(f"unknown embedder {embedder!r}; known: {', '.join(sorted(EMBEDDERS))}")
    make = EMBEDDERS[embedder]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            x = np.asarray(model(list(f["text"])), float).reshape(len(f), -1)
            x = x / np.maximum(FLOOR, np.linalg.norm(x, axis=1, keepdims=True)) if len(f) else x
            yield pd.DataFrame({"id": f["id"], "v": list(x)})

    return texts.select(F.col("id").cast("long"), "text").mapInPandas(run, "id long, v array<double>")
