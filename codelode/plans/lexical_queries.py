"""Registered queries: lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical as L
from . import relations as R

K = 20


def bm25_topk(spark, sf: str) -> DataFrame:
    return L.bm25(R.chunks(spark, sf), R.questions(spark, sf), R.FIELDS, K)


def bm25_shifted_weights(spark, sf: str) -> DataFrame:
    return L.bm25(R.chunks(spark, sf), R.questions(spark, sf), R.FIELDS, K, L.WEIGHTS_SHIFTED)


def all_terms_match(spark, sf: str) -> DataFrame:
    return L.all_terms_match(R.chunks(spark, sf), R.questions(spark, sf), R.FIELDS, K)


def graduated_search(spark, sf: str) -> DataFrame:
    return L.graduated(R.chunks(spark, sf), R.questions(spark, sf), R.FIELDS, K)


def avg_idf(spark, sf: str) -> DataFrame:
    return L.average_idf(R.chunks(spark, sf), R.questions(spark, sf), R.FIELDS).select("query_id", F.round("avg_idf", 6).alias("avg_idf"))


def adaptive_weights(spark, sf: str) -> DataFrame:
    w = L.adaptive_weights(L.average_idf(R.chunks(spark, sf), R.questions(spark, sf), R.FIELDS), R.FIELDS)
    return w.select("query_id", *[F.round(c, 6).alias(c) for c in ("avg_idf", "w_content", "w_file_path")])


def lexical_search(spark, sf: str) -> DataFrame:
    return L.search(R.chunks(spark, sf), R.questions(spark, sf), R.FIELDS, K)


def path_bonus(spark, sf: str) -> DataFrame:
    """Questions are the paths of one directory each: the bonus is what tells the directories apart."""
    c = R.chunks(spark, sf)
    q = c.select(T.directory(F.col("file_path")).alias("d")).distinct().select(F.col("d").alias("query_id"), F.replace(F.col("d"), F.lit("/"), F.lit(" ")).alias("question"))
    scored = q.crossJoin(L._small(q.select(F.col("query_id").alias("other")), L.BROADCAST_TERMS)).select("query_id", F.col("other").alias("chunk_id"), F.concat("other", F.lit("/x.txt")).alias("file_path"), F.lit(1.0).alias("score"))
    return L.path_bonus(scored, q).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def phrase_match(spark, sf: str) -> DataFrame:
    """How often each question, whole, occurs in each document, word for word."""
    phrases = R.questions(spark, sf).select("query_id", F.array_join(T.tokens(F.col("question")), " ").alias("term"))
    return L.phrase_counts(R.chunks(spark, sf), phrases, "content").join(phrases, "term").select("query_id", "chunk_id", "hits")


def dynamic_topk(spark, sf: str) -> DataFrame:
    n = R.chunks(spark, sf).groupBy("language").agg(F.count("*").alias("n"))
    return n.select("language", "n", L.dynamic_top_k(F.col("n")).alias("top_k"))


def path_keyword(spark, sf: str) -> DataFrame:
    words = R.chunks(spark, sf).select(F.concat(F.split("file_path", "/")[0], F.lit("/")).alias("word")).distinct()
    return L.path_keyword(R.chunks(spark, sf), words)


def _terms(spark, sf: str) -> DataFrame:
    """Each source asks for its own name and for its languages'."""
    c = R.chunks(spark, sf).select(F.split("file_path", "/")[0].alias("query_id"), F.col("symbol_name")).distinct()
    w = Window.partitionBy("query_id").orderBy("symbol_name")
    return c.select("query_id", (F.row_number().over(w) - 1).alias("pos"), F.col("symbol_name").alias("word"))


def path_boost(spark, sf: str) -> DataFrame:
    terms = _terms(spark, sf).select("query_id", "pos", F.concat(F.element_at(F.split("word", "_"), 2), F.lit("/"), F.element_at(F.split("word", "_"), 1)).alias("word"))
    found = R.chunks(spark, sf).groupBy(F.split("file_path", "/")[0].alias("query_id")).agg(F.min("chunk_id").alias("chunk_id"))
    best = found.select("query_id", F.lit(8.0).alias("best"))
    return L.path_boost(R.chunks(spark, sf), terms, found, best)


def symbol_seeds(spark, sf: str) -> DataFrame:
    terms = _terms(spark, sf)
    return L.symbol_seeds(R.chunks(spark, sf), terms, terms.select("query_id", F.lit(2.0).alias("best")).distinct())


def symbol_search(spark, sf: str) -> DataFrame:
    c = R.chunks(spark, sf)
    symbols = c.select(T.symbol_id(F.col("file_path"), F.col("qualified_name"), F.col("symbol_kind")).alias("symbol_id"), "symbol_name", "qualified_name", "file_path", F.col("symbol_kind").alias("kind"), "language")
    q = c.select("symbol_name", "language").distinct().select(F.col("symbol_name").alias("query_id"), F.col("symbol_name").alias("query"), F.lit(None).cast("string").alias("kind"), "language")
    return L.symbol_search(symbols, q, K)


def has_data(spark, sf: str) -> DataFrame:
    """By language, whether any chunk has a token to search."""
    return R.chunks(spark, sf).groupBy("language").agg(F.max(F.size(T.tokens(F.col("content"))) > 0).alias("has_data"))


_STOP = ", ".join(f"'{w}'" for w in sorted(T.SEARCH_STOP))
_CLEAN = f"list_filter(list_transform({R.blanks('question')}, lambda w: regexp_replace(w, '[^a-zA-Z0-9_.]', '', 'g')), lambda w: w <> '' and lower(w) not in ({_STOP}))"
PHRASES = f"""p0 as (select query_id, list_filter(list_transform({_CLEAN}, lambda w: array_to_string({R.tok("w")}, ' ')), lambda w: w <> '') as w from questions),
phrases as (select query_id, len(w) as n, generate_subscripts(w, 1) - 1 as pos, unnest(w) as term from p0)"""
MATCHES = f"""toks as (select chunk_id, {R.tok("content")} as tc, {R.tok("file_path")} as tp from chunks),
st as (select count(*)::double as n_chunks, avg(len(tc) + len(tp)) as avg_dl from toks),
occ as (select chunk_id, dl, term, sum(fc)::double as fc, sum(fp)::double as fp from
  (select chunk_id, len(tc) + len(tp) as dl, unnest(tc) as term, 1 as fc, 0 as fp from toks union all select chunk_id, len(tc) + len(tp), unnest(tp), 0, 1 from toks)
  where term in (select term from phrases) group by all),
df as (select term, count(*)::double as df from occ group by 1)"""


def _contrib(wc: str, wp: str, own: str = "") -> str:
    f = f"({wc} * fc + {wp} * fp)"
    return f"""contrib as (select query_id, n, pos, chunk_id,
  case when ln((n_chunks - df + 0.5::double) / (df + 0.5::double)) > 0 then ln((n_chunks - df + 0.5::double) / (df + 0.5::double)) else 1e-6 end
  * ({f} * 2.2::double) / ({f} + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl)) as c
  from occ join df using (term) join phrases using (term) {own} cross join st)"""


_BASE = (R.CHUNKS, R.QUESTIONS, PHRASES, MATCHES)


def _top(scored: str, k: int = K, more: str = "") -> str:
    return f"""select query_id, chunk_id, {more} score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank
  from (select query_id, chunk_id, {more} round(score, 6) as score from ({scored}))) where rank <= {k}"""


def _bm25(w: dict) -> str:
    return R.with_(*_BASE, _contrib(f"{w['content']}::double", f"{w['file_path']}::double")) + "\n" + _top("select query_id, chunk_id, sum(c) as score from contrib group by all")


BM25 = _bm25(L.WEIGHTS)
STAGES = """g0 as (select query_id, n, chunk_id, list_sort(list(c), 'desc') as c from contrib group by all),
g1 as (select query_id, n, chunk_id, len(c) as m, list_sum(c) as t, list_sum(c) - c[len(c)] as less, c[1] + c[2] as two from g0),
g2 as (select *, case when n > 1 and m = n then t end as s1, case when n >= 3 then case when m = n then less when m = n - 1 then t end end as s2 from g1),
g3 as (select *, case when n >= 4 then greatest(s2, case when m >= 2 then two end) end as s3 from g2),
h as (select query_id, case when count(s1) >= 10 then 1 when count(s2) >= 10 then 2 when count(s3) >= 10 then 3 else 4 end as stage from g3 group by 1),
graded as (select query_id, chunk_id, stage, case stage when 1 then s1 when 2 then s2 when 3 then s3 else t end as score from g3 join h using (query_id))"""
IDF = """a0 as (select query_id, avg(ln(n_chunks / df)) as a from phrases join df using (term) cross join st group by 1),
aidf as (select query_id, coalesce(a, 0) as avg_idf from questions left join a0 using (query_id)),
own as (select query_id, avg_idf, 1.0::double as w_content, 4.0::double + least(1, greatest(0, avg_idf / 2.5::double)) * (1.5::double - 4.0::double) as w_file_path from aidf)"""
SEARCH = R.with_(*_BASE, IDF, _contrib("w_content", "w_file_path", "join own using (query_id)"), STAGES) + f""",
best as ({_top("select query_id, chunk_id, score from graded where score is not null", 2 * K)}),
bonus as (select query_id, chunk_id, file_path, score * (1 + 0.2::double * len(list_filter(list_transform({_CLEAN}, lambda w: lower(w)), lambda w: list_contains(regexp_split_to_array(lower(file_path), '[/\\\\._]'), w)))) as score
  from best join chunks using (chunk_id) join questions using (query_id))
""" + _top("select * from bonus", K, "file_path,")

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_shifted_weights, all_terms_match, graduated_search, avg_idf, adaptive_weights, lexical_search, path_bonus, phrase_match, dynamic_topk, path_keyword, path_boost, symbol_seeds, symbol_search, has_data)}

_TERMS = """terms as (select split_part(file_path, '/', 1) as query_id, symbol_name as word, row_number() over (partition by split_part(file_path, '/', 1) order by symbol_name) - 1 as pos
  from (select distinct split_part(file_path, '/', 1) || '/' as file_path, symbol_name from chunks))"""
SQL = {
    "bm25_topk": BM25,
    "bm25_shifted_weights": _bm25(L.WEIGHTS_SHIFTED),
    "all_terms_match": R.with_(*_BASE, _contrib("1.0::double", "1.5::double")) + "\n" + _top("select query_id, chunk_id, sum(c) as score from contrib group by query_id, n, chunk_id having count(*) = n"),
    "graduated_search": R.with_(*_BASE, _contrib("1.0::double", "1.5::double"), STAGES) + "\n" + _top("select * from graded where score is not null", K, "stage,"),
    "avg_idf": R.with_(*_BASE, IDF) + " select query_id, round(avg_idf, 6) as avg_idf from aidf",
    "adaptive_weights": R.with_(*_BASE, IDF) + " select query_id, round(avg_idf, 6) as avg_idf, round(w_content, 6) as w_content, round(w_file_path, 6) as w_file_path from own",
    "lexical_search": SEARCH,
    "path_bonus": f"""with d as (select distinct source || '/' || lang as d, source, lang from documents)
select a.d as query_id, b.d as chunk_id, round(1 + 0.2::double * len(list_filter([a.source, a.lang], lambda w: list_contains([b.source, b.lang], w))), 6) as score from d a, d b""",
    "phrase_match": f"""with c as (select doc_id as chunk_id, ' ' || array_to_string({R.tok("text")}, ' ') || ' ' as t from documents),
q as (select item_id as query_id, array_to_string({R.tok("text")}, ' ') as p from benchmark)
select query_id, chunk_id, ((len(t) - len(replace(t, ' ' || p || ' ', ' '))) // (len(p) + 1))::bigint as hits from c join q on contains(t, ' ' || p || ' ')""",
    "dynamic_topk": "select lang as language, count(*) as n, case when count(*) <= 100 then 30 when count(*) <= 500 then 50 when count(*) <= 2000 then 100 else 150 end as top_k from documents group by 1",
    "path_keyword": R.with_(R.CHUNKS) + " select w.word, chunk_id, file_path from chunks join (select distinct source || '/' as word from documents) w on contains(file_path, w.word)",
    "path_boost": R.with_(R.CHUNKS, _TERMS) + """, t as (select query_id, pos, split_part(word, '_', 2) || '/' || split_part(word, '_', 1) as word from terms),
f as (select split_part(file_path, '/', 1) as query_id, min(chunk_id) as chunk_id from chunks group by 1),
h as (select query_id, pos, chunk_id from (select query_id, pos, chunk_id, row_number() over (partition by query_id, pos order by chunk_id) as r from chunks join t on contains(file_path, word)) where r <= 20),
x as (select query_id, chunk_id, min(pos) as pos from h anti join f using (query_id, chunk_id) group by all)
select query_id, chunk_id, 4.0::double as score from (select *, row_number() over (partition by query_id order by pos, chunk_id) as r from x) where r <= 30""",
    "symbol_seeds": R.with_(R.CHUNKS, _TERMS) + """,
h as (select * from (select query_id, pos, chunk_id, case when symbol_name = word then 0.6::double else 0.15::double end as x, row_number() over (partition by query_id, pos order by chunk_id) as r from chunks join terms on contains(symbol_name, word) or contains(qualified_name, word)) where r <= 20),
f as (select query_id, chunk_id, min(struct_pack(pos := pos, x := x)) as f from h group by all)
select query_id, chunk_id, f.x * 2.0::double as score from (select *, row_number() over (partition by query_id order by f.pos, chunk_id) as r from f) where r <= 20""",
    "symbol_search": R.with_(R.CHUNKS) + f""",
s as (select file_path || '::' || qualified_name || '#' || symbol_kind as symbol_id, symbol_name, qualified_name, file_path, language from chunks),
q as (select distinct symbol_name as query_id, ' ' || array_to_string({R.tok("symbol_name")}, ' ') || ' ' as p, language from chunks),
x as (select query_id, symbol_id, p, unnest(list_transform([symbol_id, symbol_name, qualified_name, file_path], lambda c: ' ' || array_to_string({R.tok("c")}, ' ') || ' ')) as t from s join q using (language)),
y as (select query_id, symbol_id, sum((len(t) - len(replace(t, p, ' '))) // (len(p) - 1))::double as score from x group by all having score > 0)
select * from (select *, row_number() over (partition by query_id order by score desc, symbol_id) as rank from y) where rank <= {K}""",
    "has_data": f"select lang as language, max(len({R.tok('text')}) > 0) as has_data from documents group by 1",
}
