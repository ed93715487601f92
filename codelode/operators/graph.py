"""Dependency graphs as edges (source, target). Iterations write each round to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import directory
from ..storage import components, materialize

#: Paths of a directory that are paired with as many others in one go.
PAIRED = 4096
#: Sources of edges up to which their ranks are broadcast.
BROADCAST_SOURCES = 1_000_000


def dedupe(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge for each pair; with `order`, its last attributes win."""
    if order is None:
        return edges.dropDuplicates(["source", "target"])
    rest = [c for c in edges.columns if c not in ("source", "target", order)]
    if not rest:
        return edges.select("source", "target").distinct()
    return edges.groupBy("source", "target").agg(F.max_by(F.struct(*rest), order).alias("x")).select("source", "target", "x.*")


def known_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node (node)."""
    return edges.join(nodes.select(F.col("node").alias("target")).distinct(), "target", "left_semi")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()


def co_directory(paths: DataFrame, edges: DataFrame | None = None, block: int = PAIRED) -> DataFrame:
    """Edges (source, target, kind) both ways between the files (path) of each directory, but for pairs that are edges already.

    As many edges as pairs: meant for code directories, and used only where imports give no edges at all. A path carries
    its edges to its directory, so pairs are neither shuffled nor written; a directory's are made in blocks by blocks.
    """
    d = paths.select("path").where("path is not null").distinct().withColumn("d", directory(F.col("path")))
    a = d.withColumn("known", F.array().cast("array<string>"))
    if edges is not None:
        inside = edges.where(directory(F.col("source")) == directory(F.col("target"))).groupBy(F.col("source").alias("path")).agg(F.collect_set("target").alias("known"))
        a = d.join(inside, "path", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    # small against the files, as there are fewer directories
    n = d.groupBy("d").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own, every = F.expr("cast(pmod(xxhash64(path), n) as int)"), F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = a.join(n, "d").select("d", "path", "known", own.alias("i"), every.alias("j"))
    b = d.join(n, "d").select("d", F.col("path").alias("target"), own.alias("j"), every.alias("i"))
    out = a.join(b, ["d", "i", "j"]).where("path <> target and not array_contains(known, target)")
    return out.select(F.col("path").alias("source"), "target", F.lit("co_directory").alias("kind"))


def with_fallback(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The import edges, or where there are none, and more than one file, the edges between files of a directory."""
    return co_directory(paths) if edges.isEmpty() and paths.limit(2).count() > 1 else edges


def update(edges: DataFrame, removed: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Edges without those at removed nodes (node), and new ones added."""
    r = removed.select("node").distinct()
    kept = edges.join(r.withColumnRenamed("node", "source"), "source", "left_anti").join(r.withColumnRenamed("node", "target"), "target", "left_anti")
    return kept.select("source", "target").unionByName(new_edges.select("source", "target")).distinct()


def successors(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, imports): the sorted targets of each node, or of the nodes in start."""
    e = edges.select(F.col("source").alias("node"), "target").distinct()
    e = e if start is None else e.join(start.select("node").distinct(), "node", "left_semi")
    return e.groupBy("node").agg(F.array_sort(F.collect_set("target")).alias("imports"))


def predecessors(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, used_by): the sorted sources of each node."""
    e = edges.select(F.col("target").alias("node"), "source").distinct()
    e = e if start is None else e.join(start.select("node").distinct(), "node", "left_semi")
    return e.groupBy("node").agg(F.array_sort(F.collect_set("source")).alias("used_by"))


def counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.countDistinct("node").alias("n_nodes")).crossJoin(edges.agg(F.count_distinct("source", "target").alias("n_edges")))


def neighborhood(edges: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """(start, node, hop): all nodes within `hops` edges, in either direction, of each node in start (node), itself left out."""
    both = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).union(edges.select("target", "source")).distinct()
    seen = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct()
    edge_of = seen
    for h in range(1, hops + 1):
        step = edge_of.join(both, F.col("node") == F.col("x")).select("start", F.col("y").alias("node"), F.lit(h).alias("hop")).distinct()
        edge_of = materialize(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "hop")
        seen = seen.union(edge_of)
    return seen.where("hop > 0")


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, restart: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank): ranks add up to 1. Stops after `rounds`, or once all changes together are under tolerance x nodes.

    restart (node, weight) gives the nodes where a walk begins again; those outside the graph don't count, and if none is
    in it there are no rows. Without it every node is as likely. Mass of nodes without targets is spread like restarts.
    """
    # by target, so that a round sums up flows where the edges are
    e = materialize(edges.select("source", "target").distinct().repartition("target"), "edges")
    all_nodes = nodes_of(e) if nodes is None else nodes.select("node").union(nodes_of(e)).distinct()
    out = e.groupBy("source").agg(F.count("*").alias("out")).withColumnRenamed("source", "node")
    base = all_nodes.join(out, "node", "left")
    if restart is None:
        n = all_nodes.count()
        base = base.withColumn("p", F.lit(1.0 / n if n else 0.0))
    else:
        inside = restart.groupBy("node").agg(F.sum("weight").alias("weight")).join(all_nodes, "node", "left_semi")
        total = inside.agg(F.sum("weight")).first()[0]
        if not total:
            return base.select("node", F.lit(0.0).alias("rank")).where(F.lit(False))
        base = base.join(inside, "node", "left").withColumn("p", F.coalesce("weight", F.lit(0.0)) / F.lit(float(total))).drop("weight")
        n = all_nodes.count()
    base = materialize(base, "nodes")
    ranks = base.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    loose = F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0))
    mass = ranks.agg(loose).first()[0] or 0.0
    # few sources go to the edges, which then stay where they are in all rounds
    hint = F.broadcast if base.where("out is not null").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else lambda x: x
    for _ in range(rounds if n else 0):
        flow = hint(ranks.where("out is not null").select(F.col("node").alias("source"), (F.col("rank") / F.col("out")).alias("f"))).join(e, "source").groupBy(F.col("target").alias("node")).agg(F.sum("f").alias("f"))
        new = alpha * (F.coalesce("f", F.lit(0.0)) + F.lit(float(mass)) * F.col("p")) + (1 - alpha) * F.col("p")
        ranks = materialize(ranks.withColumnRenamed("rank", "was").drop("f").join(flow, "node", "left").select("node", "out", "p", new.alias("rank"), "was"), "ranks")
        change, mass = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("was"))), loose).first()
        ranks = ranks.drop("was")
        if change < tolerance * n:
            break
    return ranks.select("node", "rank")


def normalized_pagerank(edges: DataFrame, restart: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): the personalized rank times ln(1 / (1e-6 + the global rank)), which takes hubs down."""
    own = pagerank(edges, alpha, rounds, tolerance, restart).withColumnRenamed("rank", "own")
    return own.join(pagerank(edges, alpha, rounds, tolerance), "node").select("node", (F.col("own") * F.log(1 / (F.lit(1e-6) + F.col("rank")))).alias("rank"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) by connected component, edges taken in both directions."""
    return components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))


def subgraph(edges: DataFrame, included: DataFrame) -> DataFrame:
    """(node, imports): the included nodes' targets among the included."""
    i = included.select("node").distinct()
    e = edges.join(i.withColumnRenamed("node", "source"), "source", "left_semi").join(i.withColumnRenamed("node", "target"), "target", "left_semi")
    return successors(e)


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module, n_files, cohesion): edges within a module, direction disregarded, over its pairs, to 4 decimals; 1 for a single file."""
    m = members.select("module", "node").distinct()
    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()
    inner = pair.join(m.select("module", F.col("node").alias("a")), "a").join(m.select(F.col("module").alias("module_b"), F.col("node").alias("b")), "b").where("module = module_b").groupBy("module").agg(F.count("*").alias("e"))
    n = F.col("n_files")
    return m.groupBy("module").agg(F.count("*").alias("n_files")).join(inner, "module", "left").select("module", "n_files", F.when(n < 2, 1.0).otherwise(F.round(F.coalesce("e", F.lit(0)) / (n * (n - 1) / 2), 4)).alias("cohesion"))



def _louvain(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """node -> least node of its community, by greedy modularity in passes over nodes in order of name, then over communities."""
    names = sorted({x for p in pairs for x in p})
    index = {n: k for k, n in enumerate(names)}
    links: list[dict[int, float]] = [{} for _ in names]
    for a, b in pairs:
        x, y = index[a], index[b]
        links[x][y] = links[x].get(y, 0.0) + 1.0
        links[y][x] = links[y].get(x, 0.0) + 1.0
    owner = list(range(len(names)))
    while True:
        degree = [sum(v.values()) for v in links]
        total = sum(degree) or 1.0
        own, mass, moved_any, moved = list(range(len(links))), degree[:], False, True
        while moved:
            moved = False
            for v in range(len(links)):
                near: dict[int, float] = {}
                for u, w in links[v].items():
                    if u != v:
                        near[own[u]] = near.get(own[u], 0.0) + w
                mass[own[v]] -= degree[v]
                stay = near.get(own[v], 0.0) - degree[v] * mass[own[v]] / total
                best, gain = own[v], stay
                for c in sorted(near):
                    g = near[c] - degree[v] * mass[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += degree[v]
                if best != own[v]:
                    own[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        ids = {c: k for k, c in enumerate(sorted(set(own)))}
        merged: list[dict[int, float]] = [{} for _ in ids]
        for v, row in enumerate(links):
            for u, w in row.items():
                x, y = ids[own[v]], ids[own[u]]
                merged[x][y] = merged[x].get(y, 0.0) + w
        owner = [ids[own[o]] for o in owner]
        links = merged
    first: dict[int, str] = {}
    for n, o in zip(names, owner):
        first.setdefault(o, n)
    return {n: first[o] for n, o in zip(names, owner)}


def communities(edges: DataFrame) -> DataFrame:
    """(node, module): modules of greatest modularity, direction disregarded; a module is named by its least node.

    Connected components are found first and each is one task's, as modules never span two of them: the largest
    component, a repository's files as a rule, has to fit one task.
    """
    import pandas as pd

    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()
    parts = pair.join(connected(edges).withColumnRenamed("node", "a"), "a")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        found = _louvain(sorted(zip(f["a"], f["b"])))
        return pd.DataFrame({"node": list(found), "module": list(found.values())})

    return parts.groupBy("root").applyInPandas(run, "node string, module string")


def module_name(members: DataFrame) -> DataFrame:
    """(module, name) of members (module, node): base name of the directories' common beginning, or of the only file without its ending."""
    d = members.select("module", "node", directory(F.col("node")).alias("d"))
    g = d.groupBy("module").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("node").alias("node"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("lo"))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= F.length("lo")) & (F.substring(F.col("lo"), i, F.lit(1)) == F.substring(F.col("hi"), i, F.lit(1))), i).otherwise(n))
    prefix = F.regexp_replace(F.substring(F.col("lo"), F.lit(1), same), "/+$", "")
    stem = F.regexp_replace(F.regexp_extract("node", "[^/]*$", 0), r"\.[^.]*$", "")
    base = F.regexp_extract(prefix, "[^/]*$", 0)
    return g.select("module", F.when(base != "", base).otherwise(stem).alias("name"))
