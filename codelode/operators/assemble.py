"""From ranked chunks and a dependency graph to chunks under a token budget, for many questions at once.

Relations: chunks (chunk_id, file_path, content, symbol_kind, token_count), hits (query_id, chunk_id, file_path, score,
rank), edges (source, target) between file paths, questions (query_id, question, budget). Everything is keyed by
query_id, and what is collected for one question is bounded by the ranked lists and the caps below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intent import with_weights
from ..functions.text import directory, is_architecture, is_entry_point, is_test_path, query_terms
from ..storage import materialize
from . import fusion, graph
from .lexical import BROADCAST_TERMS, _small


@dataclass(frozen=True)
class Settings:
    import_decay: float = 0.65
    importer_decay: float = 0.35
    floor_ratio: float = 0.30
    expansion_files: int = 8
    max_files: int = 8
    chunks_per_file: int = 3
    convergence: float = 1.5
    expansion_min: float = 0.05
    file_cutoff: float = 0.10
    test_seed: float = 0.6
    test_penalty: float = 0.3
    entry_boost: float = 1.3
    directory_boost: float = 1.2


def dynamic_budget(total: Column, budget: Column) -> Column:
    """All tokens of a small corpus, the budget from three times its size on, and in between a straight line between factors 1 and 1 of both."""
    t = (total - budget) / (2 * budget)
    return F.when(total <= budget, total).when(total >= 3 * budget, budget).otherwise(F.floor(total + t * (budget - total))).cast("long")


def capped_budget(total: Column, budget: Column) -> Column:
    """dynamic_budget(), never above the budget that was asked for."""
    return F.least(dynamic_budget(total, budget), budget)


def passthrough(chunks: DataFrame, budget: int) -> DataFrame:
    """(chunk_id, score) with score 1 of all chunks, if they fit into the budget together; else no rows."""
    total = chunks.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("total"))
    return chunks.select("chunk_id").crossJoin(F.broadcast(total)).where(F.col("total") <= budget).select("chunk_id", F.lit(1.0).alias("score"))


def max_normalized(hits: DataFrame) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.col("score") / F.when(F.coalesce(top, F.lit(0.0)) == 0, 1.0).otherwise(top))


def seed_scores(hits: DataFrame, vector_hits: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """(query_id, file_path, seed, norm): each file's best score, tests at 60 %; vector hits only of files without others, the first one."""
    effective = F.col("score") * F.when(is_test_path(F.col("file_path")), s.test_seed).otherwise(1.0)
    out = hits.groupBy("query_id", "file_path").agg(F.max(effective).alias("seed"))
    if vector_hits is not None:
        more = vector_hits.groupBy("query_id", "file_path").agg(F.min_by(effective, "rank").alias("seed"))
        out = out.unionByName(more.join(out, ["query_id", "file_path"], "left_anti"))
    top = F.max("seed").over(Window.partitionBy("query_id"))
    return out.withColumn("norm", F.col("seed") / F.when(top == 0, 1.0).otherwise(top))


def _mentions(path: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(path), t))


def _steps(seeds: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """(query_id, seed_file, seed, file_path, forward): one edge from every seed that counts to files that are no seeds."""
    e = edges.select("source", "target").distinct()
    strong = seeds.where(F.col("norm") >= s.expansion_min).select("query_id", F.col("file_path").alias("seed_file"), "seed")
    out = strong.join(e, F.col("seed_file") == F.col("source")).select("query_id", "seed_file", "seed", F.col("target").alias("file_path"), F.lit(True).alias("forward"))
    back = strong.join(e, F.col("seed_file") == F.col("target")).select("query_id", "seed_file", "seed", F.col("source").alias("file_path"), F.lit(False).alias("forward"))
    return out.union(back).join(seeds.select("query_id", "file_path"), ["query_id", "file_path"], "left_anti")


def expansion(seeds: DataFrame, edges: DataFrame, questions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, file_path, priority, sources): files one import away from seeds.

    An imported file counts its seed's score, an importing one half of it, half as much again if its path has a term of
    the question; sums of two sources or more count 1.5 times.
    """
    q = questions.select("query_id", query_terms(F.col("question")).alias("terms"))
    x = _steps(seeds, edges, s).join(q, "query_id")
    part = F.col("seed") * F.when(F.col("forward"), 1.0).otherwise(0.5) * F.when(_mentions(F.col("file_path"), F.col("terms")), 1.5).otherwise(1.0)
    g = x.groupBy("query_id", "file_path").agg(F.sum(part).alias("p"), F.count("*").alias("sources"))
    return g.select("query_id", "file_path", (F.col("p") * F.when(F.col("sources") >= 2, s.convergence).otherwise(1.0)).alias("priority"), "sources")


def first_hop(candidates: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, file_path, priority, place): the expansion's best files that are no tests."""
    w = Window.partitionBy("query_id").orderBy(F.round("priority", 9).desc(), "file_path")
    return candidates.where(~is_test_path(F.col("file_path"))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= s.expansion_files).select("query_id", "file_path", "priority", "place")


def second_hop(hop1: DataFrame, seeds: DataFrame, edges: DataFrame, questions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, file_path, priority, place): for questions about architecture, what first-hop files import, while places are left."""
    q = questions.where(is_architecture(F.col("question"))).select("query_id", query_terms(F.col("question")).alias("terms"))
    used = seeds.select("query_id", "file_path").union(hop1.select("query_id", "file_path"))
    x = hop1.join(q, "query_id").join(edges.select("source", "target").distinct(), F.col("file_path") == F.col("source"))
    x = x.select("query_id", F.col("target").alias("file_path"), "priority", "terms").join(used, ["query_id", "file_path"], "left_anti")
    part = F.col("priority") * F.when(_mentions(F.col("file_path"), F.col("terms")), 1.5).otherwise(1.0)
    g = x.groupBy("query_id", "file_path").agg(F.max(part).alias("priority")).where(~is_test_path(F.col("file_path")))
    room = hop1.groupBy("query_id").agg((F.lit(s.expansion_files) - F.count("*")).alias("room"))
    w = Window.partitionBy("query_id").orderBy(F.round("priority", 9).desc(), "file_path")
    return g.join(room, "query_id").withColumn("place", F.row_number().over(w)).where("place <= room").select("query_id", "file_path", "priority", "place")


def file_chunks(files: DataFrame, chunks: DataFrame, found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, chunk_id, file_path): the first chunks, in order of id, of the files (query_id, file_path) that are not found yet."""
    c = _small(materialize(files.select("query_id", "file_path"), "files"), BROADCAST_TERMS).join(chunks.select("chunk_id", "file_path"), "file_path").join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id", "file_path").orderBy("chunk_id")
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= s.chunks_per_file).select("query_id", "chunk_id", "file_path")


def neighbor_boosts(seeds: DataFrame, relevance: DataFrame, edges: DataFrame, questions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, file_path, boost): what files one import away from a seed take over of its best relevance (query_id, chunk_id, file_path, score)."""
    q = questions.select("query_id", query_terms(F.col("question")).alias("terms"))
    best = relevance.groupBy("query_id", F.col("file_path").alias("seed_file")).agg(F.max("score").alias("r"))
    x = _steps(seeds, edges, s).join(best, ["query_id", "seed_file"], "left").join(q, "query_id")
    rate = F.when(F.col("forward"), s.import_decay * F.when(_mentions(F.col("file_path"), F.col("terms")), 1.3).otherwise(1.0)).otherwise(s.importer_decay)
    return x.groupBy("query_id", "file_path").agg(F.max(F.coalesce("r", F.lit(0.0)) * rate).alias("boost"))


def module_cohesion(candidates: DataFrame, modules: DataFrame) -> DataFrame:
    """(query_id, file_path, cohesion): share of a module's files among the candidates', times the module's own cohesion.

    modules: (module, file_path, cohesion_score).
    """
    files = candidates.select("query_id", "file_path").distinct()
    n = modules.groupBy("module").agg(F.count("*").alias("n"))
    x = files.join(modules, "file_path").join(n, "module")
    here = F.count("*").over(Window.partitionBy("query_id", "module"))
    return x.select("query_id", "file_path", (here / F.col("n") * F.col("cohesion_score")).alias("cohesion"))


def final_scores(candidates: DataFrame, chunks: DataFrame, relevance: DataFrame, boosts: DataFrame, centrality: DataFrame, questions: DataFrame, cohesion: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """(query_id, chunk_id, file_path, token_count, relevance, structural, type_coverage, cohesion, final)."""
    q = with_weights(questions.select("query_id", "question")).select("query_id", query_terms(F.col("question")).alias("terms"), "w_relevance", "w_structural", "w_type", "w_cohesion")
    x = _small(materialize(candidates.select("query_id", "chunk_id", "file_path"), "candidates"), BROADCAST_TERMS).join(chunks.select("chunk_id", "symbol_kind", "token_count"), "chunk_id")
    x = x.join(relevance.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left").join(boosts, ["query_id", "file_path"], "left")
    x = x.join(centrality.select(F.col("node").alias("file_path"), F.col("rank").alias("pr")), "file_path", "left").join(_small(q, BROADCAST_TERMS), "query_id")
    x = x.join(cohesion, ["query_id", "file_path"], "left") if cohesion is not None else x.withColumn("cohesion", F.lit(0.0))
    score = F.coalesce("score", F.lit(0.0))
    x = x.withColumns(
        {
            "relevance": F.when(score != 0, score).otherwise(F.coalesce("boost", F.lit(0.0))),
            "structural": F.coalesce("pr", F.lit(0.0)),
            "type_coverage": F.when(F.col("symbol_kind").isin("class", "type", "interface"), 0.5).otherwise(0.0),
            "cohesion": F.coalesce("cohesion", F.lit(0.0)),
        }
    )
    path = F.col("file_path")
    segments = F.filter(F.split(F.lower(directory(path)), "/"), lambda d: F.length(d) >= 3)
    sum_ = F.col("w_relevance") * F.col("relevance") + F.col("w_structural") * F.col("structural") + F.col("w_type") * F.col("type_coverage") + F.col("w_cohesion") * F.col("cohesion")
    final = sum_ * F.when(is_test_path(path), s.test_penalty).otherwise(1.0) * F.when(is_entry_point(path), s.entry_boost).otherwise(1.0) * F.when(F.arrays_overlap(segments, F.col("terms")), s.directory_boost).otherwise(1.0)
    return x.withColumn("final", F.round(final, 9)).select("query_id", "chunk_id", "file_path", "token_count", "relevance", "structural", "type_coverage", "cohesion", "final")


def file_cap(scores: Column, most: int = 8) -> Column:
    """How many files to keep of scores in descending order: fewer, the farther the best one is ahead of the middle one."""
    n = F.size(scores)
    ratio = scores[0] / scores[F.floor(n / 2).cast("int")]
    return F.when(n < 3, F.least(F.lit(most), n)).when(scores[F.floor(n / 2).cast("int")] <= 0, most).when(ratio > 3.0, 5).when(ratio > 2.0, 6).otherwise(most)


def file_cut(ranked: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ranked (query_id, file_path, final, ...) in the best files: at least 10 % of the best one's score, and within file_cap()."""
    f = ranked.groupBy("query_id", "file_path").agg(F.max("final").alias("file_score"))
    by = Window.partitionBy("query_id")
    order = by.orderBy(F.col("file_score").desc(), "file_path")
    scores = F.sort_array(F.collect_list("file_score").over(by), asc=False)
    keep = f.withColumn("place", F.row_number().over(order)).withColumn("scores", scores)
    keep = keep.where((F.col("place") <= file_cap(F.col("scores"), s.max_files)) & (F.col("file_score") >= F.col("scores")[0] * s.file_cutoff))
    return ranked.join(keep.select("query_id", "file_path"), ["query_id", "file_path"], "left_semi")


def greedy_pack(ranked: DataFrame, budgets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, chunk_id, place, used): chunks (query_id, chunk_id, final, token_count) in order of score.

    Stops below 30 % of the best score; a chunk that would exceed the budget (query_id, budget) is passed over.
    """
    g = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("final")).alias("f"), "chunk_id", F.col("token_count").cast("long").alias("t")))).alias("c")).join(budgets.select("query_id", "budget"), "query_id")
    item = "struct<chunk_id:string,used:bigint>" if dict(ranked.dtypes)["chunk_id"] == "string" else f"struct<chunk_id:{dict(ranked.dtypes)['chunk_id']},used:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{item}>").alias("got"))
    floor = F.col("c")[0]["f"] * s.floor_ratio

    def step(acc: Column, x: Column) -> Column:
        fits = (x["f"] <= floor) & (acc["used"] + x["t"] <= F.col("budget"))
        after = acc["used"] + x["t"]
        return F.when(fits, F.struct(after.alias("used"), F.concat(acc["got"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), after.alias("used")))).alias("got"))).otherwise(acc)

    packed = g.select("query_id", F.aggregate("c", start, step)["got"].alias("got"))
    return packed.select("query_id", F.posexplode("got").alias("place", "x")).select("query_id", "x.chunk_id", (F.col("place") + 1).alias("place"), F.col("x.used").alias("used"))


def assemble(hits: DataFrame, edges: DataFrame, chunks: DataFrame, questions: DataFrame, vector_hits: DataFrame | None = None, avg_idf: DataFrame | None = None, modules: DataFrame | None = None, centrality: DataFrame | None = None, s: Settings = Settings(), rounds: int = 100) -> DataFrame:
    """(query_id, place, chunk_id, file_path, final, used): fuse, expand, score, cut and pack."""
    relevance = hits
    seeds_from_vectors = None
    if vector_hits is not None:
        gate = fusion.fusion_gate(hits, vector_hits, avg_idf).select("query_id", "fuse")
        fused = fusion.adaptive_rsf(hits, vector_hits).join(gate.where("fuse"), "query_id", "left_semi")
        paths = hits.select("query_id", "chunk_id", "file_path").union(vector_hits.select("query_id", "chunk_id", "file_path")).distinct()
        plain = hits.join(gate.where("fuse"), "query_id", "left_anti").select("query_id", "chunk_id", "file_path", "score", "rank")
        relevance = fused.join(paths, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "file_path", "score", "rank").union(plain)
        seeds_from_vectors = vector_hits.join(gate.where("fuse"), "query_id", "left_semi")
    relevance = materialize(max_normalized(relevance), "relevance")
    seeds = materialize(seed_scores(hits, seeds_from_vectors, s), "seeds")
    found = relevance.select("query_id", "chunk_id", "file_path")
    hop1 = materialize(first_hop(expansion(seeds, edges, questions, s), s), "hop1")
    hop2 = second_hop(hop1, seeds, edges, questions, s)
    more = file_chunks(hop1.select("query_id", "file_path").union(hop2.select("query_id", "file_path")), chunks, found, s)
    candidates = found.union(more)
    boosts = neighbor_boosts(seeds, relevance, edges, questions, s)
    rank = graph.pagerank(edges, rounds=rounds) if centrality is None else centrality
    coh = module_cohesion(candidates, modules) if modules is not None else None
    scored = materialize(final_scores(candidates, chunks, relevance, boosts, rank, questions, coh, s), "scored")
    packed = greedy_pack(file_cut(scored, s), questions, s)
    return packed.join(scored.select("query_id", "chunk_id", "file_path", "final"), ["query_id", "chunk_id"]).select("query_id", "place", "chunk_id", "file_path", "final", "used")
