"""Fusing two ranked lists. Lists are rows (query_id, chunk_id, file_path, score, rank); many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def score_cv(hits: DataFrame, top_n: int = 10) -> DataFrame:
    """(query_id, cv): standard deviation over mean of the first scores; 0 for fewer than two, or a mean near 0."""
    g = hits.where(F.col("rank") <= top_n).groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return g.select("query_id", F.when((F.col("n") < 2) | (F.col("m") < 1e-9), 0.0).otherwise(F.col("s") / F.col("m")).alias("cv"))


def agreement(a: DataFrame, b: DataFrame, top_n: int = 20) -> DataFrame:
    """(query_id, agreement): Jaccard similarity of the files of both lists' first entries; 0 where one is missing."""
    files = lambda x, n: x.where(F.col("rank") <= top_n).groupBy("query_id").agg(F.collect_set("file_path").alias(n))
    both = files(a, "x").join(files(b, "y"), "query_id", "full")
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in ("x", "y"))
    return both.select("query_id", F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0).alias("agreement"))


def fusion_gate(a: DataFrame, b: DataFrame, avg_idf: DataFrame | None = None, idf_below: float = 2.0, cv_above: float = 0.8, agreement_above: float = 0.8, least: int = 3) -> DataFrame:
    """(query_id, fuse, reason): whether the second list should be fused into the first."""
    count = lambda x, n: x.groupBy("query_id").agg(F.count("*").alias(n))
    t = count(a, "na").join(count(b, "nb"), "query_id", "full").join(score_cv(a), "query_id", "left").join(agreement(a, b), "query_id", "left")
    t = t.join(avg_idf, "query_id", "left") if avg_idf is not None else t.withColumn("avg_idf", F.lit(None).cast("double"))
    few = (F.coalesce("na", F.lit(0)) < least) | (F.coalesce("nb", F.lit(0)) < least)
    common = F.col("avg_idf") < idf_below
    sure = (F.coalesce("cv", F.lit(0.0)) > cv_above) & (F.coalesce("agreement", F.lit(0.0)) > agreement_above)
    reason = F.when(few, "too few results").when(common, "common terms").when(sure, "confident and agreed").otherwise("signals differ")
    return t.select("query_id", F.when(few, False).when(common, True).when(sure, False).otherwise(True).alias("fuse"), reason.alias("reason"))


def _both(a: DataFrame, b: DataFrame, value: Column, *own: str) -> DataFrame:
    x = a.select("query_id", "chunk_id", value.alias("x"))
    y = b.select("query_id", "chunk_id", value.alias("y"))
    return x.join(y, ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def _ranked(fused: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return fused.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(w))


def rrf(a: DataFrame, b: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, rank): sums of 1 / (k + rank)."""
    return _ranked(_both(a, b, F.lit(1.0) / (F.lit(k) + F.col("rank"))).select("query_id", "chunk_id", (F.col("x") + F.col("y")).alias("score")))


def rrf_weights(agreement: Column, cv: Column) -> Column:
    """The first list's weight by how much both agree and how far its scores spread; the other's is the rest."""
    return F.when(agreement > 0.7, 0.85).when(agreement < 0.3, 0.35).when(cv > 0.3, 0.5).otherwise(0.4)


def rsf_weights(agreement: Column, cv: Column) -> Column:
    return F.when(agreement > 0.7, 0.6).when(agreement < 0.3, 0.35).when(cv > 0.3, 0.5).otherwise(0.4)


def _with_weights(a: DataFrame, b: DataFrame, fused: DataFrame, weight) -> DataFrame:
    t = agreement(a, b).join(score_cv(a), "query_id", "left").select("query_id", weight(F.col("agreement"), F.coalesce("cv", F.lit(0.0))).alias("w"))
    return _ranked(fused.join(t, "query_id").select("query_id", "chunk_id", (F.col("w") * F.col("x") + (1 - F.col("w")) * F.col("y")).alias("score")))


def weighted_rrf(a: DataFrame, b: DataFrame, k: int = RRF_K) -> DataFrame:
    return _with_weights(a, b, _both(a, b, F.lit(1.0) / (F.lit(k) + F.col("rank"))), rrf_weights)


def minmax(hits: DataFrame) -> DataFrame:
    """hits with score between 0 and 1 by question; 0.5 where all scores are the same."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.when(hi - lo < 1e-9, 0.5).otherwise((F.col("score") - lo) / (hi - lo)))


def rsf(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score, rank): weighted sums of min-max scores, 0 on the side that lacks a chunk."""
    both = _both(minmax(a), minmax(b), F.col("score"))
    return _ranked(both.select("query_id", "chunk_id", (weight * F.col("x") + (1 - weight) * F.col("y")).alias("score")))


def adaptive_rsf(a: DataFrame, b: DataFrame) -> DataFrame:
    return _with_weights(a, b, _both(minmax(a), minmax(b), F.col("score")), rsf_weights)
