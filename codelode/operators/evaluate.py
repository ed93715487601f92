"""Retrieval quality: metrics of ranked files against expected ones, gates, baselines, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["recall", "precision", "f1_score", "mrr", "ndcg", "map_score", "token_efficiency"]
THRESHOLDS = {"recall": 0.60, "precision": 0.20, "f1_score": 0.30, "mrr": 0.55, "ndcg": 0.0, "map_score": 0.0, "token_efficiency": 0.0}


def first_places(ranked: DataFrame) -> DataFrame:
    """(task_id, file_path, rank) of ranked (task_id, file_path, pos): a file counts at its first place."""
    w = Window.partitionBy("task_id").orderBy("pos", "file_path")
    return ranked.groupBy("task_id", "file_path").agg(F.min("pos").alias("pos")).select("task_id", "file_path", F.row_number().over(w).alias("rank"))


def metrics(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(task_id, recall, precision, f1_score, mrr, ndcg, map_score) of every task in expected (task_id, file_path)."""
    e = expected.select("task_id", "file_path").distinct()
    want = e.groupBy("task_id").agg(F.count("*").alias("want"))
    r = first_places(ranked)
    shown = r.groupBy("task_id").agg(F.count("*").alias("shown"))
    hits = r.join(e, ["task_id", "file_path"]).withColumn("h", F.row_number().over(Window.partitionBy("task_id").orderBy("rank")))
    g = hits.groupBy("task_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.sum(F.col("h") / F.col("rank")).alias("ap"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("want", F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    x = want.join(shown, "task_id", "left").join(g, "task_id", "left").na.fill(0, ["shown", "found", "dcg", "ap"])
    recall, precision = F.col("found") / F.col("want"), F.when(F.col("shown") > 0, F.col("found") / F.col("shown")).otherwise(0.0)
    x = x.withColumns({"recall": recall, "precision": precision})
    f1 = F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0)
    return x.select("task_id", *[F.round(c, 6).alias(n) for n, c in (("recall", F.col("recall")), ("precision", F.col("precision")), ("f1_score", f1), ("mrr", F.coalesce(1 / F.col("first"), F.lit(0.0))), ("ndcg", F.col("dcg") / ideal), ("map_score", F.col("ap") / F.col("want")))])


def _long(results: DataFrame, names: list[str]) -> DataFrame:
    return results.unpivot(["task_id", "strategy"], names, "metric", "actual")


def gate(results: DataFrame, thresholds: dict[str, float] | None = None, exempt: list[str] | None = None, by_strategy: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(task_id, strategy, metric, threshold, actual) below its threshold; strategies can be exempt or have their own."""
    rows = [("*", m, float(x)) for m, x in (thresholds or THRESHOLDS).items()] + [(s, m, float(x)) for s, t in (by_strategy or {}).items() for m, x in t.items()]
    names = [m for m in METRICS if m in results.columns]
    t = results.sparkSession.createDataFrame(rows, "who string, metric string, threshold double")
    own = t.where("who <> '*'").withColumnRenamed("who", "strategy").withColumnRenamed("threshold", "own")
    x = _long(results, names).join(F.broadcast(t.where("who = '*'").drop("who")), "metric", "left").join(F.broadcast(own), ["strategy", "metric"], "left")
    x = x.withColumn("threshold", F.coalesce("own", "threshold")).where("actual < threshold")
    return (x.where(~F.col("strategy").isin(exempt)) if exempt else x).select("task_id", "strategy", "metric", "threshold", "actual")


def latency_warnings(results: DataFrame, most_ms: float = 5000.0) -> DataFrame:
    return results.where(F.col("wall_time_ms") > most_ms).select("task_id", "strategy", "wall_time_ms")


def delta_gate(results: DataFrame, least: float = 1.5) -> DataFrame:
    """(task_id, violation) of results (task_id, speedup, correct)."""
    slow = results.where(F.col("speedup") < least).select("task_id", F.lit("speedup").alias("violation"))
    return slow.union(results.where(~F.col("correct")).select("task_id", F.lit("correctness").alias("violation")))


def compare_baseline(results: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(task_id, strategy, metric, base, actual, regression): below the baseline by more than the tolerance."""
    names = [m for m in METRICS if m in results.columns]
    b = _long(baseline, names).withColumnRenamed("actual", "base")
    return _long(results, names).join(b, ["task_id", "strategy", "metric"]).withColumn("regression", F.col("actual") < F.col("base") - tolerance)


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Means of all metrics."""
    return results.groupBy(*by).agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS if m in results.columns], F.count("*").alias("tasks"))


def win_counts(results: DataFrame) -> DataFrame:
    """(strategy, metric, wins): best of each task and metric; ties go to the first strategy by name."""
    names = [m for m in METRICS if m in results.columns]
    w = Window.partitionBy("task_id", "metric").orderBy(F.col("actual").desc(), "strategy")
    return _long(results, names).withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("strategy", "metric").agg(F.count("*").alias("wins"))


def savings(raw: DataFrame, out: DataFrame) -> DataFrame:
    """(task_id, raw_tokens, out_tokens, savings_pct)."""
    x = raw.join(out, "task_id")
    return x.withColumn("savings_pct", F.round(F.when(F.col("raw_tokens") > 0, 100 * (1 - F.col("out_tokens") / F.col("raw_tokens"))).otherwise(0.0), 1))


def trace_summary(steps: DataFrame) -> DataFrame:
    """(step, calls, total_ms, mean_ms, max_ms) of steps (step, ms)."""
    return steps.groupBy("step").agg(F.count("*").alias("calls"), F.round(F.sum("ms"), 3).alias("total_ms"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.max("ms").alias("max_ms"))
