"""Registered queries: from ranked chunks to chunks under a token budget, stage by stage and whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as T
from ..operators import assemble as A
from ..operators import graph as G
from ..operators import render as N
from . import graph_queries as GQ
from . import lexical_queries as LQ
from . import relations as R
from . import text_queries as TQ


class _Inputs:
    """What the stages share, each computed once."""

    def __init__(self, spark, sf: str):
        self.chunks, self.questions, self.edges = R.chunks(spark, sf), R.questions(spark, sf), R.saved(R.file_edges(spark, sf), "edges")
        self.hits = R.saved(R.few(LQ.bm25_topk(spark, sf)).join(self.chunks.select("chunk_id", "file_path"), "chunk_id"), "hits")
        self.seeds = R.saved(A.seed_scores(self.hits), "seeds")

    def hop1(self) -> DataFrame:
        return R.saved(A.first_hop(A.expansion(self.seeds, self.edges, self.questions)), "hop1")

    def relevance(self) -> DataFrame:
        return A.max_normalized(self.hits)

    def scored(self) -> DataFrame:
        found = self.hits.select("query_id", "chunk_id", "file_path")
        boosts = A.neighbor_boosts(self.seeds, self.relevance(), self.edges, self.questions)
        hop1 = self.hop1()
        hop2 = A.second_hop(hop1, self.seeds, self.edges, self.questions)
        files = hop1.select("query_id", "file_path").union(hop2.select("query_id", "file_path"))
        candidates = found.union(A.file_chunks(files, self.chunks, found))
        rank = G.pagerank(self.edges, rounds=GQ.ROUNDS, tolerance=0.0)
        return A.final_scores(candidates, self.chunks, self.relevance(), boosts, rank, self.questions)


def dynamic_budget(spark, sf: str) -> DataFrame:
    """For each source, the budget of questions about it, plain and capped."""
    t = R.chunks(spark, sf).groupBy(F.split("file_path", "/")[0].alias("source")).agg(F.sum("token_count").alias("total"))
    b = F.lit(8192).cast("long")
    return t.select("source", "total", A.dynamic_budget(F.col("total"), b).alias("budget"), A.capped_budget(F.col("total"), b).alias("capped"))


def passthrough(spark, sf: str) -> DataFrame:
    """With a budget as large as the corpus everything passes."""
    return A.passthrough(R.chunks(spark, sf), 1 << 50)


def max_normalized(spark, sf: str) -> DataFrame:
    return _Inputs(spark, sf).relevance().select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def seed_scores(spark, sf: str) -> DataFrame:
    return _Inputs(spark, sf).seeds.select("query_id", "file_path", F.round("seed", 6).alias("seed"), F.round("norm", 6).alias("norm"))


def expansion_1hop(spark, sf: str) -> DataFrame:
    return _Inputs(spark, sf).hop1().select("query_id", "file_path", R.six("priority"), "place")


def expansion_2hop(spark, sf: str) -> DataFrame:
    i = _Inputs(spark, sf)
    return A.second_hop(i.hop1(), i.seeds, i.edges, i.questions).select("query_id", "file_path", R.six("priority"), "place")


def neighbor_boost(spark, sf: str) -> DataFrame:
    i = _Inputs(spark, sf)
    return A.neighbor_boosts(i.seeds, i.relevance(), i.edges, i.questions).select("query_id", "file_path", R.six("boost"))


def final_score(spark, sf: str) -> DataFrame:
    return _Inputs(spark, sf).scored().select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), F.round("structural", 6).alias("structural"), "type_coverage", "cohesion", F.round("final", 6).alias("final"))


def module_cohesion(spark, sf: str) -> DataFrame:
    i = _Inputs(spark, sf)
    modules = GQ._members(spark, sf).join(GQ.cohesion(spark, sf), "module").select("module", F.col("node").alias("file_path"), F.col("cohesion").alias("cohesion_score"))
    return A.module_cohesion(i.hits, modules).select("query_id", "file_path", F.round("cohesion", 6).alias("cohesion"))


def adaptive_file_cap(spark, sf: str) -> DataFrame:
    g = _Inputs(spark, sf).seeds.groupBy("query_id").agg(F.sort_array(F.collect_list("seed"), asc=False).alias("s"))
    return g.select("query_id", A.file_cap(F.col("s")).cast("int").alias("cap"))


def file_cut(spark, sf: str) -> DataFrame:
    return A.file_cut(_Inputs(spark, sf).scored()).select("query_id", "chunk_id", F.round("final", 6).alias("final"))


def greedy_pack(spark, sf: str) -> DataFrame:
    """Hits by score under the budget."""
    return _packed_hits(_Inputs(spark, sf))


def _packed_hits(i: _Inputs) -> DataFrame:
    ranked = R.few(i.hits).join(i.chunks.select("chunk_id", "token_count"), "chunk_id").select("query_id", "chunk_id", F.col("score").alias("final"), "token_count")
    return A.greedy_pack(ranked, i.questions)


def assemble_context(spark, sf: str) -> DataFrame:
    i = _Inputs(spark, sf)
    rank = G.pagerank(i.edges, rounds=GQ.ROUNDS, tolerance=0.0)
    return A.assemble(i.hits, i.edges, i.chunks, i.questions, centrality=rank).select("query_id", "place", "chunk_id", "file_path", F.round("final", 6).alias("final"), "used")


def assemble_context_fused(spark, sf: str) -> DataFrame:
    """The same with a second ranked list, by sparse vectors."""
    from . import vector_queries as VQ

    i = _Inputs(spark, sf)
    _, b = VQ._lists(spark, sf)
    rank = G.pagerank(i.edges, rounds=GQ.ROUNDS, tolerance=0.0)
    return A.assemble(i.hits, i.edges, i.chunks, i.questions, vector_hits=b, avg_idf=LQ.avg_idf(spark, sf), centrality=rank).select("query_id", "place", "chunk_id", "file_path", F.round("final", 6).alias("final"), "used")


def render_bundles(spark, sf: str) -> DataFrame:
    """Each question's hits under the budget, as Markdown and XML."""
    i = _Inputs(spark, sf)
    packed = _packed_hits(i).join(i.hits.select("query_id", "chunk_id", F.col("score").alias("final")), ["query_id", "chunk_id"])
    return N.bundles(packed, i.chunks).select("query_id", N.as_markdown(F.col("items")).alias("markdown"), N.as_xml(F.col("items")).alias("xml"))


QUERIES = {
    f.__name__: f
    for f in (render_bundles, dynamic_budget, passthrough, max_normalized, seed_scores, expansion_1hop, expansion_2hop, neighbor_boost, final_score, module_cohesion, adaptive_file_cap, file_cut, greedy_pack, assemble_context, assemble_context_fused)
}

_TEST = "(starts_with(lower(file_path), 'test') or contains(lower(file_path), '/test'))"
_MENTION = "len(list_filter(terms, lambda t: contains(lower(file_path), t))) > 0"
_W3 = TQ._W3.replace("text", "question")
_TERMS = f"""qa as (select query_id, question, list_filter(list_transform(flatten(list_transform(list_filter({_W3}, lambda w: lower(w) not in {TQ._in(T.QUERY_STOP)}), lambda w: {TQ.split_compound("w")})), lambda p: lower(p)), lambda p: len(p) >= 3 and p not in {TQ._in(T.QUERY_STOP)}) as f from questions),
qb as (select query_id, question, list_distinct(list_concat(f, {TQ.pairs("f")})) as f from qa),
qt as (select query_id, list_distinct(list_concat(f, flatten(list_transform(list_filter(f, lambda t: ({TQ._SYN})[t] is not null), lambda t: ({TQ._SYN})[t])))) as terms,
  {" or ".join(f"contains(lower(question), '{k}')" for k in sorted(T.SYNONYMS))} as arch from qb)"""
HITS = LQ.BM25.rpartition("\nselect query_id, chunk_id,  score, rank")[0] + ",\nhit0 as (" + LQ._top("select query_id, chunk_id, sum(c) as score from contrib group by all") + "),\n" + R.FILE_EDGES + ",\n" + _TERMS + f""",
hits as materialized (select query_id, chunk_id, file_path, score, rank from hit0 join chunks using (chunk_id)),
rel as (select query_id, chunk_id, file_path, score / case when max(score) over (partition by query_id) = 0 then 1 else max(score) over (partition by query_id) end as score from hits),
seed0 as (select query_id, file_path, max(score * case when {_TEST} then 0.6::double else 1 end) as seed from hits group by all),
seeds as materialized (select *, seed / case when max(seed) over (partition by query_id) = 0 then 1 else max(seed) over (partition by query_id) end as norm from seed0),
strong as (select query_id, file_path as seed_file, seed from seeds where norm >= 0.05),
steps as (select * from (select query_id, seed_file, seed, target as file_path, true as fwd from strong join edges on seed_file = source union all select query_id, seed_file, seed, source, false from strong join edges on seed_file = target) anti join seeds using (query_id, file_path)),
exp as (select query_id, file_path, sum(seed * case when fwd then 1 else 0.5::double end * case when {_MENTION} then 1.5::double else 1 end) * case when count(*) >= 2 then 1.5::double else 1 end as priority from steps join qt using (query_id) group by all),
hop1 as materialized (select * from (select *, row_number() over (partition by query_id order by round(priority, 9) desc, file_path) as place from exp where not {_TEST}) where place <= 8),
x2 as (select query_id, target as file_path, priority, terms from hop1 join qt using (query_id) join edges on file_path = source where arch),
e2 as (select query_id, file_path, max(priority * case when {_MENTION} then 1.5::double else 1 end) as priority from x2 anti join seeds using (query_id, file_path) anti join hop1 using (query_id, file_path) where not {_TEST} group by all),
room as (select query_id, 8 - count(*) as room from hop1 group by 1),
hop2 as (select query_id, file_path, priority, place from (select *, row_number() over (partition by query_id order by round(priority, 9) desc, file_path) as place from e2) join room using (query_id) where place <= room),
best as (select query_id, file_path as seed_file, max(score) as r from rel group by all),
boosts as (select query_id, file_path, max(coalesce(r, 0) * case when fwd then 0.65::double * case when {_MENTION} then 1.3::double else 1 end else 0.35::double end) as boost from steps left join best using (query_id, seed_file) join qt using (query_id) group by all)
"""
_SCORED = (
    ", nodes as materialized (select source as node from edges union select target from edges),\n"
    + GQ.ranks("pr", GQ._UNIFORM)
    + f""",
asked as (select query_id as source, 0 as no, question from questions), {TQ._INTENT}, iw as (select source as query_id, w_relevance, w_structural, w_type, w_cohesion from intents join {TQ._WEIGHTS} using (intent)),
newc as (select query_id, chunk_id, file_path from (select f.query_id, c.chunk_id, c.file_path, row_number() over (partition by f.query_id, c.file_path order by c.chunk_id) as r from (select query_id, file_path from hop1 union all select query_id, file_path from hop2) f join chunks c using (file_path)
  where (f.query_id, c.chunk_id) not in (select (query_id, chunk_id) from hits)) where r <= 3),
cand as (select query_id, chunk_id, file_path from hits union all select * from newc),
sig as (select c.query_id, c.chunk_id, c.file_path, k.token_count, case when coalesce(rel.score, 0) <> 0 then rel.score else coalesce(boost, 0) end as relevance, coalesce(rank, 0) as structural, case when symbol_kind in ('class', 'type', 'interface') then 0.5::double else 0 end as type_coverage, terms, iw.*
  from cand c join chunks k using (chunk_id) left join rel on rel.query_id = c.query_id and rel.chunk_id = c.chunk_id left join boosts b on b.query_id = c.query_id and b.file_path = c.file_path left join pr on pr.node = c.file_path join qt on qt.query_id = c.query_id join iw on iw.query_id = c.query_id),
scored as materialized (select query_id, chunk_id, file_path, token_count, relevance, structural, type_coverage, round((w_relevance * relevance + w_structural * structural + w_type * type_coverage) * case when {_TEST} then 0.3::double else 1 end
  * case when regexp_extract(file_path, '[^/]*$') in {TQ._in(T.ENTRY_POINTS)} then 1.3::double else 1 end
  * case when len(list_intersect(list_filter(string_split(lower(regexp_replace(file_path, '/[^/]*$', '')), '/'), lambda d: len(d) >= 3), terms)) > 0 then 1.2::double else 1 end, 9) as final from sig),
fs as (select query_id, file_path, max(final) as s from scored group by all),
fl as (select query_id, list_sort(list(s), 'desc') as l from fs group by 1),
fc as (select query_id, l[1] as top, case when len(l) < 3 then least(8, len(l)) when l[len(l) // 2 + 1] <= 0 then 8 when l[1] / l[len(l) // 2 + 1] > 3 then 5 when l[1] / l[len(l) // 2 + 1] > 2 then 6 else 8 end as cap from fl),
kept as (select query_id, file_path from (select *, row_number() over (partition by query_id order by s desc, file_path) as place from fs) join fc using (query_id) where place <= cap and s >= top * 0.1::double),
cut as (select scored.* from scored semi join kept using (query_id, file_path))
"""
)


def _packed(ranked: str) -> str:
    return f"""o as materialized (select query_id, chunk_id, token_count as t, final, row_number() over (partition by query_id order by final desc, chunk_id) as i, max(final) over (partition by query_id) as top from ({ranked})),
p as (select query_id, 0::bigint as i, 0::bigint as used, false as fits, null::bigint as chunk_id from questions
  union all select p.query_id, o.i, used + case when o.final >= top * 0.3::double and used + t <= 8192 then t else 0 end, o.final >= top * 0.3::double and used + t <= 8192, o.chunk_id from p join o on o.query_id = p.query_id and o.i = p.i + 1),
packed as (select query_id, chunk_id, row_number() over (partition by query_id order by i) as place, used from p where fits)"""


def _esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_REC = lambda s: s.replace("with ", "with recursive ", 1)
SQL = {
    "dynamic_budget": f"""with t as (select source, sum(floor(len({R.blanks("text")}) * 1.3::double)::bigint)::bigint as total from documents group by 1),
b as (select source, total, case when total <= 8192 then total when total >= 24576 then 8192 else floor(total + (total - 8192) / 16384::double * (8192 - total))::bigint end as budget from t) select source, total, budget, least(budget, 8192) as capped from b""",
    "passthrough": "select doc_id as chunk_id, 1.0::double as score from documents",
    "max_normalized": HITS + "select query_id, chunk_id, round(score, 6) as score from rel",
    "seed_scores": HITS + "select query_id, file_path, round(seed, 6) as seed, round(norm, 6) as norm from seeds",
    "expansion_1hop": HITS + f"select query_id, file_path, {R.six_sql('priority')}, place from hop1",
    "expansion_2hop": HITS + f"select query_id, file_path, {R.six_sql('priority')}, place from hop2",
    "neighbor_boost": HITS + f"select query_id, file_path, {R.six_sql('boost')} from boosts",
    "final_score": HITS + _SCORED + "select query_id, chunk_id, round(relevance, 6) as relevance, round(structural, 6) as structural, type_coverage, 0.0::double as cohesion, round(final, 6) as final from scored",
    "module_cohesion": HITS + """, m as (select source as module, path as file_path from paths), pe as (select distinct least(source, target) as a, greatest(source, target) as b from edges where source <> target),
ie as (select a.module, count(*) as e from pe join m a on a.file_path = pe.a join m b on b.file_path = pe.b where a.module = b.module group by 1), nm as (select module, count(*) as n from m group by 1),
co as (select module, n, case when n < 2 then 1.0::double else round(coalesce(e, 0) / (n * (n - 1) / 2::double), 4) end as c from nm left join ie using (module)), hf as (select distinct query_id, file_path from hits)
select query_id, file_path, round(count(*) over (partition by query_id, module) / n::double * c, 6) as cohesion from hf join m using (file_path) join co using (module)""",
    "adaptive_file_cap": HITS + ", sl as (select query_id, list_sort(list(seed), 'desc') as l from seeds group by 1) select query_id, (case when len(l) < 3 then least(8, len(l)) when l[len(l) // 2 + 1] <= 0 then 8 when l[1] / l[len(l) // 2 + 1] > 3 then 5 when l[1] / l[len(l) // 2 + 1] > 2 then 6 else 8 end)::int as cap from sl",
    "file_cut": HITS + _SCORED + "select query_id, chunk_id, round(final, 6) as final from cut",
    "greedy_pack": _REC(HITS) + "," + _packed("select query_id, chunk_id, score as final, token_count from hits join chunks using (chunk_id)") + " select query_id, chunk_id, place, used from packed",
    "render_bundles": _REC(HITS) + "," + _packed("select query_id, chunk_id, score as final, token_count from hits join chunks using (chunk_id)") + f""" select query_id, string_agg('## ' || file_path || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```', chr(10) || chr(10) order by place) as markdown,
'<context>' || string_agg('<chunk file="' || {_esc("file_path")} || '">' || {_esc("content")} || '</chunk>', '' order by place) || '</context>' as xml from packed join chunks using (chunk_id) group by 1""",
    "assemble_context": _REC(HITS) + _SCORED + "," + _packed("select * from cut") + " select query_id, place, chunk_id, file_path, round(final, 6) as final, used from packed join (select query_id, chunk_id, file_path, final from scored) using (query_id, chunk_id)",
}
