"""Registered queries: chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from . import relations as R


def line_pack_chunks(spark, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return C.line_pack(d).select(F.col("id").alias("doc_id"), "part", "start_line", "end_line", "token_count", "content")


def uncovered_ranges(spark, sf: str) -> DataFrame:
    t = R.turns(spark, sf)
    return C.uncovered(t, t.groupBy("file_path").agg((F.max("end_line") + 2).alias("total_lines")))


def _candidates(spark, sf: str) -> DataFrame:
    """Turns of assistants are symbols, others are lines of none."""
    t = R.turns(spark, sf)
    return t.select("file_path", F.col("turn").cast("int").alias("pos"), "start_line", F.when(F.col("kind") == "assistant", F.col("qualified_name")).alias("symbol"), T.word_estimate(F.col("content")).alias("token_count"))


def merge_small_chunks(spark, sf: str) -> DataFrame:
    return C.merge_small(_candidates(spark, sf)).select("file_path", "place", "start_line", "symbol", "token_count", F.array_join("pieces", ",").alias("pieces"))


def symbol_id_disambiguation(spark, sf: str) -> DataFrame:
    t = R.turns(spark, sf).select("file_path", "turn", "start_line", T.symbol_id(F.col("file_path"), F.col("qualified_name"), F.lit("method")).alias("symbol_id"))
    return C.disambiguated(t).select("file_path", "turn", "symbol_id")


def _imports(spark) -> DataFrame:
    rows = [("os.path", ["the", "les"], None), ("net.que", [], None), ("json", [], "der"), ("a.b", ["zzz"], "und"), ("zq", ["xq"], "")]
    return spark.createDataFrame(rows, "module string, names array<string>, alias string")


def import_relevance(spark, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").crossJoin(F.broadcast(_imports(spark)))
    m, n, a = F.col("module"), F.col("names"), F.col("alias")
    return d.where(C.import_relevant(F.col("text"), m, n, a)).select("doc_id", C.format_import(m, n, a).alias("statement"))


def chunk_files(spark, sf: str) -> DataFrame:
    """Whole chunking of conversations as files: turns of assistants are symbols."""
    t = R.turns(spark, sf)
    lines = F.concat(F.repeat(F.lit("# gap\n"), F.col("turn").cast("int")), "content")
    files = t.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("c")))), lambda x: x["c"]), "\n").alias("content"))
    symbols = t.where("kind = 'assistant'").select("file_path", F.concat("qualified_name", F.lit("_"), "turn").alias("name"), "start_line", "end_line")
    return C.chunk_files(files, symbols)


QUERIES = {f.__name__: f for f in (line_pack_chunks, uncovered_ranges, merge_small_chunks, symbol_id_disambiguation, import_relevance, chunk_files)}

_EST = f"floor(len({R.blanks('{}')}) * 1.3::double)::bigint"
SQL = {
    "line_pack_chunks": f"""with recursive l as (select doc_id, string_split(text, chr(10)) as lines, list_transform(string_split(text, chr(10)), lambda x: {_EST.format("x")}) as t from documents),
r as (select doc_id, 1::bigint as s, 0::bigint as part from l
  union all select doc_id, nxt, part + 1 from (select r.doc_id, r.part, len(l.t) as n, r.s + 1 + (select count(*) from range(r.s + 1, len(l.t) + 1) k(i) where list_sum(list_slice(l.t, r.s, i)) <= {C.MAX_TOKENS}) as nxt from r join l using (doc_id)) where nxt <= n),
e as (select *, coalesce(lead(s) over (partition by doc_id order by part) - 1, n) as f from (select r.*, len(l.t) as n from r join l using (doc_id)))
select doc_id, part, s as start_line, f as end_line, list_sum(list_slice(t, s, f))::bigint as token_count, array_to_string(list_slice(lines, s, f), chr(10)) as content from e join l using (doc_id)""",
    "uncovered_ranges": R.with_(R.TURNS) + """, s as (select *, coalesce(max(end_line) over (partition by file_path order by start_line, end_line rows between unbounded preceding and 1 preceding), 0) as reach from turns)
select file_path, reach + 1 as start_line, start_line - 1 as end_line from s where start_line > reach + 1
union all select file_path, max(end_line) + 1, max(end_line) + 2 from turns group by 1""",
    "symbol_id_disambiguation": R.with_(R.TURNS) + """, i as (select *, file_path || '::' || qualified_name || '#method' as id from turns), n as (select *, row_number() over (partition by file_path, id order by start_line) as n from i)
select file_path, turn, case when n > 1 then id || '@' || n else id end as symbol_id from n""",
    "import_relevance": """select doc_id, s as statement from documents, (values ('from os.path import the, les', ['the', 'les'], null), ('import net.que', ['que'], null), ('import json as der', ['json'], 'der'), ('from a.b import zzz as und', ['zzz'], 'und'), ('from zq import xq', ['xq'], null)) t(s, names, alias)
where coalesce(contains(text, alias), false) or len(list_filter(names, lambda n: contains(text, n))) > 0""",
}
