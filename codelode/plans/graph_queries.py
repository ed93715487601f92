"""Registered queries: dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from . import relations as R

ROUNDS = 20


def edges_dedupe(spark, sf: str) -> DataFrame:
    return G.dedupe(R.page_edges(spark, sf))


def known_targets(spark, sf: str) -> DataFrame:
    """Of all references, those to files of languages that are parsed."""
    nodes = R.chunks(spark, sf).where("language in ('en', 'de')").select(F.col("file_path").alias("node"))
    return G.known_targets(R.file_edges(spark, sf), nodes).select("source", "target")


def co_directory(spark, sf: str) -> DataFrame:
    return G.co_directory(R.chunks(spark, sf).select(F.col("file_path").alias("path")), R.file_edges(spark, sf))


def graph_update(spark, sf: str) -> DataFrame:
    """One source's files go; their references come back turned round."""
    e = R.file_edges(spark, sf)
    gone = R.chunks(spark, sf).where(F.col("file_path").startswith("src3/")).select(F.col("file_path").alias("node"))
    new = e.where(F.col("source").startswith("src3/")).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return G.update(e, gone, new)


def successors(spark, sf: str) -> DataFrame:
    return G.successors(R.page_edges(spark, sf)).select("node", F.array_join("imports", " ").alias("imports"))


def predecessors(spark, sf: str) -> DataFrame:
    return G.predecessors(R.page_edges(spark, sf)).select("node", F.array_join("used_by", " ").alias("used_by"))


def graph_counts(spark, sf: str) -> DataFrame:
    e = R.page_edges(spark, sf)
    return G.counts(e, G.nodes_of(e))


def neighborhood_2hop(spark, sf: str) -> DataFrame:
    e = R.page_edges(spark, sf)
    return G.neighborhood(e, G.nodes_of(e), 2)


def _six(df: DataFrame) -> DataFrame:
    return df.select("node", F.round("rank", 9).alias("rank"))


def pagerank(spark, sf: str) -> DataFrame:
    return _six(G.pagerank(R.supply_edges(spark, sf), rounds=ROUNDS, tolerance=0.0))


def _restart(spark, sf: str) -> DataFrame:
    """Every page, weighed by how many links it has."""
    return R.page_edges(spark, sf).groupBy(F.col("source").alias("node")).agg(F.count("*").cast("double").alias("weight"))


def personalized_pagerank(spark, sf: str) -> DataFrame:
    return _six(G.pagerank(R.page_edges(spark, sf), rounds=ROUNDS, tolerance=0.0, restart=_restart(spark, sf)))


def normalized_pagerank(spark, sf: str) -> DataFrame:
    return _six(G.normalized_pagerank(R.page_edges(spark, sf), _restart(spark, sf), rounds=ROUNDS, tolerance=0.0))


def components(spark, sf: str) -> DataFrame:
    return G.connected(R.file_edges(spark, sf))


def modules(spark, sf: str) -> DataFrame:
    return G.communities(R.file_edges(spark, sf))


def _members(spark, sf: str) -> DataFrame:
    return R.chunks(spark, sf).select(F.split("file_path", "/")[0].alias("module"), F.col("file_path").alias("node"))


def cohesion(spark, sf: str) -> DataFrame:
    return G.cohesion(R.file_edges(spark, sf), _members(spark, sf))


def module_names(spark, sf: str) -> DataFrame:
    return G.module_name(_members(spark, sf))


def dependency_subgraph(spark, sf: str) -> DataFrame:
    inside = R.chunks(spark, sf).where("language in ('en', 'de')").select(F.col("file_path").alias("node"))
    return G.subgraph(R.file_edges(spark, sf), inside).select("node", F.array_join("imports", " ").alias("imports"))


QUERIES = {
    f.__name__: f
    for f in (edges_dedupe, known_targets, co_directory, graph_update, successors, predecessors, graph_counts, neighborhood_2hop, pagerank, personalized_pagerank, normalized_pagerank, components, modules, cohesion, module_names, dependency_subgraph)
}

_FE = R.with_(R.FILE_EDGES)
_PE = R.with_(R.PAGE_EDGES, "edges as (select distinct source, target from links)")
_NODES = "nodes as (select source as node from edges union select target from edges)"


def ranks(name: str, p: str, rounds: int = ROUNDS, n: str = "") -> str:
    """CTEs of a fixed number of rounds, the last one called `name`; p gives restart probabilities (node, p)."""
    base = f"{name}_b as materialized (select node, o, coalesce(p, 0)::double as p, (select count(*) from nodes)::double as n from nodes left join (select source as node, count(*) as o from edges group by 1) using (node) left join ({p}) using (node))"
    out = [base, f"{name}_0 as materialized (select node, o, p, 1 / n as rank from {name}_b)"]
    for k in range(1, rounds + 1):
        w = f"{name}_{k - 1}"
        out.append(
            f"{name}_{k} as materialized (select a.node, a.o, a.p, 0.85::double * (coalesce(f, 0) + (select coalesce(sum(rank), 0) from {w} where o is null) * a.p) + 0.15::double * a.p as rank "
            f"from {w} a left join (select target as node, sum(rank / o) as f from {w} x join edges on x.node = source group by 1) using (node))"
        )
    out.append(f"{name} as (select node, rank from {name}_{rounds})")
    return ",\n".join(out)


_UNIFORM = "select node, 1 / (select count(*) from nodes)::double as p from nodes"
_RESTART = "select source as node, count(*)::double / (select count(*) from links) as p from links group by 1"
SQL = {
    "edges_dedupe": _PE + " select * from edges",
    "known_targets": _FE + ", c as (select path from paths where lang in ('en', 'de')) select source, target from edges where target in (select path from c)",
    "co_directory": _FE + ", p as (select distinct path, source || '/' || lang as d from paths) select a.path as source, b.path as target, 'co_directory' as kind from p a join p b on a.d = b.d and a.path <> b.path where (a.path, b.path) not in (select (source, target) from edges)",
    "graph_update": _FE + " select source, target from edges where not starts_with(source, 'src3/') and not starts_with(target, 'src3/') union select target, source from edges where starts_with(source, 'src3/')",
    "successors": _PE + " select source as node, string_agg(target, ' ' order by target) as imports from edges group by 1",
    "predecessors": _PE + " select target as node, string_agg(source, ' ' order by source) as used_by from edges group by 1",
    "graph_counts": _PE + f", {_NODES} select (select count(*) from nodes) as n_nodes, (select count(*) from edges) as n_edges",
    "neighborhood_2hop": _PE + """, u as (select source as x, target as y from edges union select target, source from edges), one as (select distinct x as start, y as node from u where x <> y),
two as (select distinct start, y as node from one join u on node = x where y <> start) select start, node, 1 as hop from one union all select start, node, 2 from (select * from two except select * from one)""",
    "pagerank": "with edges as materialized (select distinct 'S' || l_suppkey as source, 'P' || l_partkey as target from lineitem), nodes as materialized (select source as node from edges union select target from edges),\n" + ranks("pr", _UNIFORM) + " select node, round(rank, 9) as rank from pr",
    "personalized_pagerank": _PE + f", {_NODES}, " + ranks("pr", _RESTART) + " select node, round(rank, 9) as rank from pr",
    "normalized_pagerank": _PE + f", {_NODES}, " + ranks("pr", _UNIFORM) + ", " + ranks("own", _RESTART) + " select node, round(own.rank * ln(1 / (1e-6 + pr.rank)), 9) as rank from own join pr using (node)",
    "components": _FE.replace("with ", "with recursive ", 1) + """, u as (select source as x, target as y from edges union select target, source from edges), c(node, root) as (select x, x from u union select y, root from c join u on node = x where root < y or true)
select node, min(root) as root from c group by 1""",
    "cohesion": _FE + """, m as (select source as module, path as node from paths), p as (select distinct least(source, target) as a, greatest(source, target) as b from edges where source <> target),
i as (select a.module, count(*) as e from p join m a on a.node = p.a join m b on b.node = p.b where a.module = b.module group by 1), n as (select module, count(*) as n_files from m group by 1)
select module, n_files, case when n_files < 2 then 1.0::double else round(coalesce(e, 0) / (n_files * (n_files - 1) / 2::double), 4) end as cohesion from n left join i using (module)""",
    "module_names": """with d as (select source, min(source || '/' || lang) as lo, max(source || '/' || lang) as hi from documents group by source),
p as (select source, regexp_replace(lo[1:list_max(list_filter(range(0, len(lo) + 1), lambda i: lo[1:i] = hi[1:i]))], '/+$', '') as prefix from d)
select source as module, regexp_extract(prefix, '[^/]*$') as name from p""",
    "dependency_subgraph": _FE + ", c as (select path from paths where lang in ('en', 'de')) select source as node, string_agg(target, ' ' order by target) as imports from edges where source in (select path from c) and target in (select path from c) group by 1",
}
