"""Registered queries: structure analysis and browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyze as A
from . import relations as R

#: Which word in a text gives its class which method.
METHODS = {"the": "process", "and": "set_next", "un": "handle", "der": "register", "les": "get", "la": "subscribe", "und": "emit", "en": "save", "is": "find", "el": "on", "es": "delete", "die": "__init__"}
NAMES = ["FilterChain", "PluginRegistry", "EventBus", "DataStore", "RunnerContext", "SortPolicy", "Plain", "Emitter"]


def _symbols(spark, sf: str) -> DataFrame:
    """A class for each document, in one file for each source and language; its methods go by the words in its text."""
    d = R.table(spark, sf, "documents")
    name = F.concat(F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.length("text") % len(NAMES) + 1).cast("int")), F.lit("_"), "doc_id")
    words = F.split(F.lower("text"), "[^a-z]+")
    has = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(m).alias("m")) for w, m in METHODS.items()]), lambda x: F.array_contains(words, x["w"]))
    base = d.select(F.concat("source", F.lit("/"), "lang", F.lit(".py")).alias("file_path"), name.alias("cls"), F.transform(has, lambda x: x["m"]).alias("ms"), "n_chars")
    line = F.col("n_chars").cast("int")
    classes = base.select("file_path", F.col("cls").alias("name"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("parent"), F.lit("public").alias("visibility"), F.concat(F.lit("class "), "cls").alias("signature"), line.alias("start_line"), (line + 9).alias("end_line"))
    methods = base.select("file_path", F.explode("ms").alias("name"), "cls", line.alias("start_line")).select("file_path", "name", F.lit("method").alias("kind"), F.col("cls").alias("parent"), F.lit("public").alias("visibility"), F.concat(F.lit("def "), "name", F.lit("(self, key: dict[str, int], n: int = 3, *rest) -> list[str]:")).alias("signature"), "start_line", (F.col("start_line") + 1).alias("end_line"))
    return classes.union(methods)


def pattern_evidence(spark, sf: str) -> DataFrame:
    return A.patterns(_symbols(spark, sf))


def pattern_catalog(spark, sf: str) -> DataFrame:
    return A.catalog(A.patterns(_symbols(spark, sf)))


def decisions(spark, sf: str) -> DataFrame:
    return A.decisions(A.catalog(A.patterns(_symbols(spark, sf)))).select("decision", "evidence")


def interfaces(spark, sf: str) -> DataFrame:
    e = R.file_edges(spark, sf).select(*[F.regexp_replace(c, "/doc_.*$", ".py").alias(c) for c in ("source", "target")]).distinct()
    return A.interfaces(_symbols(spark, sf), e).select("file_path", "name", "kind", "signature", F.array_join("used_by", " ").alias("used_by"))


def parameters(spark, sf: str) -> DataFrame:
    """Parameters and return types of all methods."""
    s = _symbols(spark, sf).where("kind = 'method'")
    return s.select("file_path", "parent", "name", A.return_type(F.col("signature")).alias("returns"), F.explode(A.parameters(F.col("signature"))).alias("p")).select("file_path", "parent", "name", "returns", F.col("p.name").alias("parameter"), F.col("p.type").alias("type"), F.col("p.default").alias("default"), F.col("p.required").alias("required"))


def stats_rollup(spark, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").select(F.col("lang").alias("language"), T.line_count(F.col("text")).alias("lines"), F.lit(1).alias("symbols"))
    return A.stats(d)


def compare_dimensions(spark, sf: str) -> DataFrame:
    """Two sides: classes of files of one half of the languages against those of the other."""
    c = _symbols(spark, sf)
    side = F.when(F.col("file_path").rlike("/(en|de)[.]py$"), "a").otherwise("b")
    return A.compare(c.select(side.alias("side"), F.concat("kind", F.lit(" "), "name").alias("text")))


def file_metadata(spark, sf: str) -> DataFrame:
    """By source and language: greatest number of characters and how many documents."""
    d = R.table(spark, sf, "documents")
    return d.groupBy(F.concat("source", F.lit("/"), "lang").alias("file_path")).agg(F.min("lang").alias("language"), F.max("n_chars").alias("lines"), F.count("*").alias("chunks"))


def file_tree(spark, sf: str) -> DataFrame:
    c = R.chunks(spark, sf).select(F.col("file_path").alias("path"), T.line_count(F.col("content")).alias("lines"))
    return A.file_tree(c)


def file_outline(spark, sf: str) -> DataFrame:
    t = R.turns(spark, sf)
    roots = t.select("file_path", F.substring_index("qualified_name", ".", 1).alias("qualified_name"), F.lit(-1).cast("long").alias("turn")).distinct()
    s = t.select("file_path", "qualified_name", "turn").union(roots)
    return A.outline(s).select("file_path", "qualified_name", "turn", "parent_name")


def token_totals(spark, sf: str) -> DataFrame:
    return A.token_totals(R.chunks(spark, sf).select(F.split("file_path", "/")[0].alias("file_path"), "token_count"))


QUERIES = {f.__name__: f for f in (pattern_evidence, pattern_catalog, decisions, interfaces, parameters, stats_rollup, compare_dimensions, file_metadata, file_tree, file_outline, token_totals)}

_M = ", ".join(f"{{'w': '{w}', 'm': '{m}'}}" for w, m in METHODS.items())
SYMBOLS = f"""base as (select source || '/' || lang || '.py' as file_path, ({NAMES})[len(text) % {len(NAMES)} + 1] || '_' || doc_id as name, list_transform(list_filter([{_M}], lambda x: list_contains(regexp_split_to_array(lower(text), '[^a-z]+'), x.w)), lambda x: x.m) as methods from documents)"""


def _named(words: str) -> str:
    return f"len(list_filter({words.split()}, lambda w: contains(lower(name), w))) > 0"


def _any(words: str) -> str:
    return f"list_has_any(methods, {words.split()})"


_OWN = "list_filter(methods, lambda m: m <> '__init__')"
FOUND = f"""{SYMBOLS},
mw as (select *, {_any("set_next next")} and {_any("process handle")} as fu from base), mx as (select *, max(fu) over (partition by file_path) as ch from mw),
sh as (select file_path, list(distinct name) as sharing from (select file_path, name, m, count(distinct name) over (partition by file_path, m) as c from (select file_path, name, unnest({_OWN}) as m from base)) where c >= 2 group by 1),
s1 as (select b.*, {_OWN} as own, case when {_named("context executor runner engine sorter dispatcher")} and len({_OWN}) >= 1 then 'context' when {_named("strategy policy algorithm interface protocol")} and len({_OWN}) <= 3 then 'protocol' when list_contains(sharing, name) then 'concrete' end as role from base b join sh using (file_path)),
s2 as (select *, coalesce(bool_or(role = 'protocol') over w, false) as p, coalesce(bool_or(role = 'concrete') over w, false) as k, coalesce(bool_or(role = 'context') over w, false) as c from s1 window w as (partition by file_path)),
pm as (select file_path, flatten(list(own)) as pm from s1 where role = 'protocol' group by 1),
s3 as (select s2.* exclude (role), case when role is null and p and not k and list_has_any(methods, pm) then 'concrete' else role end as role from s2 left join pm using (file_path)),
s4 as (select *, coalesce(bool_or(role = 'concrete') over (partition by file_path), false) as kk from s3),
found as (select 'middleware_chain' as pattern, file_path, name, case when fu then 'chain' else 'participant' end as role from mx where fu or ({_any("process handle")} and ({_named("middleware handler chain filter interceptor")} or ch))
union all select 'plugin_system', file_path, name, case when {_any("register unregister")} and ({_any("get all")} or {_named("registry manager store")}) then 'registry' else 'contract' end from base where {_any("register unregister")} and ({_any("get all")} or {_named("registry manager store")}) or {_named("plugin extension handler")}
union all select 'event_bus', file_path, name, case when {_any("subscribe on listen")} and {_any("emit")} then 'bus' when {_any("subscribe on listen")} then 'subscriber' else 'emitter' end from base
  where not (list_contains(methods, 'on') and not list_contains(methods, 'subscribe') and not {_named("event bus emitter dispatcher listener")}) and ({_any("subscribe on listen")} or {_any("emit")})
union all select 'repository', file_path, name, 'repository' from base where len(list_intersect(methods, ['get', 'find', 'save', 'delete'])) >= 3 or (len(list_intersect(methods, ['get', 'find', 'save', 'delete'])) >= 2 and {_named("repo repository dao store data")})
union all select 'strategy', file_path, name, role from s4 where role is not null and kk and (p or c))"""
_CAT = FOUND + ", cat as (select pattern, count(*) as evidence, case when count(*) >= 3 then 0.85::double when count(*) = 2 then 0.6::double else 0.3::double end as confidence from found group by 1)"
SQL = {
    "pattern_evidence": f"with {FOUND} select * from found",
    "pattern_catalog": f"with {_CAT} select * from cat",
    "decisions": f"with {_CAT} select 'uses ' || replace(pattern, '_', ' ') as decision, evidence from cat where confidence >= 0.5",
    "interfaces": R.with_(R.FILE_EDGES, SYMBOLS) + """, e as (select distinct regexp_replace(source, '/doc_.*$', '.py') as source, regexp_replace(target, '/doc_.*$', '.py') as target from edges),
u as (select target as file_path, string_agg(source, ' ' order by source) as used_by from e group by 1) select file_path, name, 'class' as kind, 'class ' || name as signature, coalesce(used_by, '') as used_by from base left join u using (file_path)""",
    "parameters": f"with {SYMBOLS}, m as (select file_path, name as parent, unnest(methods) as name from base) select file_path, parent, name, 'list[str]' as returns, p.* from m, (values ('key', 'dict[str, int]', null, true), ('n', 'int', '3', false), ('rest', null, null, false)) p(parameter, type, \"default\", required)",
    "stats_rollup": """with l as (select lang as language, case when text = '' then 0 else len(text) - len(replace(text, chr(10), '')) + case when ends_with(text, chr(10)) then 0 else 1 end end as lines from documents),
g as (select language, count(*) as files, sum(lines)::bigint as lines, count(*) as symbols from l group by rollup (language)) select *, round(100.0::double * files / max(files) over (), 2) as percent from g""",
    "compare_dimensions": f"with {SYMBOLS}, s as (select case when regexp_matches(file_path, '/(en|de)[.]py$') then 'a' else 'b' end as side, lower('class ' || name) as t from base union all select case when regexp_matches(file_path, '/(en|de)[.]py$') then 'a' else 'b' end, lower('method ' || unnest(methods)) from base), d(dimension, words) as (values "
    + ", ".join(f"('{k}', {v.split()})" for k, v in A.DIMENSIONS.items())
    + """), n as (select dimension, count(*) filter (side = 'a') as n_a, count(*) filter (side = 'b') as n_b from d left join s on len(list_filter(words, lambda w: contains(t, w))) > 0 group by 1)
select dimension, n_a, n_b, case when n_a = 0 then 'none found' else n_a || ' found' end as approach_a, case when n_b = 0 then 'none found' else n_b || ' found' end as approach_b,
case when n_a = 0 and n_b = 0 then 'neither' when n_a = 0 then 'only b' when n_b = 0 then 'only a' when n_a > 2 * n_b then 'a far ahead' when n_b > 2 * n_a then 'b far ahead' else 'comparable' end as trade_off from n""",
    "file_metadata": "select source || '/' || lang as file_path, min(lang) as language, max(n_chars) as lines, count(*) as chunks from documents group by 1",
    "file_tree": R.with_(R.CHUNKS) + """, l as (select string_split(file_path, '/') as p, case when content = '' then 0 else len(content) - len(replace(content, chr(10), '')) + case when ends_with(content, chr(10)) then 0 else 1 end end as n from chunks),
x as (select array_to_string(p[:d], '/') as path, array_to_string(p[:d - 1], '/') as parent, d::int as depth, d < 3 as is_directory, n from l, range(1, 4) t(d)) select path, parent, depth, is_directory, count(*) as files, sum(n)::bigint as lines from x group by all""",
    "file_outline": R.with_(R.TURNS) + ", s as (select file_path, qualified_name, turn from turns union all select distinct file_path, split_part(qualified_name, '.', 1), -1 from turns) select file_path, qualified_name, turn, case when contains(qualified_name, '.') then split_part(qualified_name, '.', 1) end as parent_name from s",
    "token_totals": f"select source as file_path, sum(floor(len({R.blanks('text')}) * 1.3::double)::bigint)::bigint as tokens, count(*) as chunks from documents group by rollup (source)",
}
