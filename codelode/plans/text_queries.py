"""Registered queries: words, identifiers, paths and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as T
from . import relations as R

#: Documents read as questions: what a question's operators do to every text of the corpus.
_NAMES = "concat('get', upper(substr(lang, 1, 1)), lower(substr(lang, 2)), '_', source, 'Item handleHTTPRequest ', source, '_', lang)"


def _docs(spark, sf: str) -> DataFrame:
    return R.table(spark, sf, "documents")


def _with_names(spark, sf: str) -> DataFrame:
    """Texts after compound identifiers made of their own language and source."""
    return _docs(spark, sf).select("doc_id", F.concat(F.expr(_NAMES), F.lit(" "), "text").alias("text"))


def _said(spark, sf: str) -> DataFrame:
    """Every turn of every conversation, read as a question."""
    return R.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.expr("concat('get', role, ' ', 'http', upper(substr(role, 1, 1)), substr(role, 2), ' session_', role, ' ')"), "text").alias("text"))


def expand_identifiers(spark, sf: str) -> DataFrame:
    return _with_names(spark, sf).select("doc_id", T.expand_identifiers(F.col("text")).alias("expanded"))


def compound_split(spark, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", F.explode(F.split(F.expr(_NAMES), " ")).alias("token"))
    return d.select("doc_id", "token", F.array_join(T.compound_split(F.col("token")), " ").alias("parts"))


def query_terms(spark, sf: str) -> DataFrame:
    return _said(spark, sf).select("conv_id", "turn", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def path_terms(spark, sf: str) -> DataFrame:
    return _said(spark, sf).select("conv_id", "turn", F.array_join(T.path_terms(F.col("text")), " ").alias("terms"))


def symbol_terms(spark, sf: str) -> DataFrame:
    return _said(spark, sf).select("conv_id", "turn", F.array_join(T.symbol_terms(F.col("text")), " ").alias("terms"))


def keywords(spark, sf: str) -> DataFrame:
    return _said(spark, sf).select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


_QUESTIONS = [
    "Where is SessionPool defined?", "what is the definition of the retry loop", "Why does the parser raise an exception", "stack trace in worker startup", "who calls open_session",
    "what uses the scheduler", "How does the routing system work", "overview of the middleware pipeline", "HTTPClient send_request", "explain how values are cached", "", "how is the config file read and merged",
]


def _asked(spark, sf: str) -> DataFrame:
    """Typical questions about every source."""
    q = spark.createDataFrame(list(enumerate(_QUESTIONS)), "no int, q string")
    return _docs(spark, sf).select("source").distinct().crossJoin(F.broadcast(q)).select("source", "no", F.when(F.col("q") == "", "").otherwise(F.concat("q", F.lit(" "), "source")).alias("question"))


def intent_classify(spark, sf: str) -> DataFrame:
    return _asked(spark, sf).select("source", "no", I.classify(F.col("question")).alias("intent"))


def intent_weights(spark, sf: str) -> DataFrame:
    return I.with_weights(_asked(spark, sf)).select("source", "no", "intent", "w_relevance", "w_structural", "w_type", "w_cohesion")


def architecture_question(spark, sf: str) -> DataFrame:
    return _asked(spark, sf).select("source", "no", T.is_architecture(F.col("question")).alias("is_architecture"))


def _paths(spark, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    shapes = F.array(
        F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/mod"), "doc_id", F.lit(".py")),
        F.concat(F.lit("lib/"), "source", F.lit("/__init__.py")),
        F.concat(F.lit("tests/"), "source", F.lit("/test_"), "doc_id", F.lit(".ts")),
        F.concat(F.lit("web/"), "lang", F.lit("/index.js")),
        F.concat("source", F.lit("/node_modules/x/"), "doc_id", F.lit(".go")),
        F.concat("source", F.lit("/README.md")),
    )
    return d.select("doc_id", F.explode(shapes).alias("path"))


def file_to_module(spark, sf: str) -> DataFrame:
    return _paths(spark, sf).select("doc_id", "path", T.module_of(F.col("path")).alias("module"))


def path_flags(spark, sf: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf).select("doc_id", "path", T.language_of(p).alias("language"), T.is_test_path(p).alias("is_test"), T.is_entry_point(p).alias("is_entry"), T.matches_ignore(p, ["node_modules/", "*.egg-info/", "README.md"]).alias("ignored"), T.directory(p).alias("directory"))


def file_scan(spark, sf: str) -> DataFrame:
    """Paths as discovery keeps them: known languages, nothing ignored."""
    p = F.col("path")
    return _paths(spark, sf).where(T.language_of(p).isNotNull() & ~T.matches_ignore(p, ["node_modules/"])).select("doc_id", "path", T.language_of(p).alias("language"))


def breadcrumbs(spark, sf: str) -> DataFrame:
    t = R.turns(spark, sf)
    crumb = T.breadcrumbs(F.col("file_path"), F.col("qualified_name"), F.col("kind"), T.parent_name(F.col("qualified_name")), F.lit(None).cast("string"))
    return t.select("file_path", "turn", crumb.alias("breadcrumbs"))


def surrogate_text(spark, sf: str) -> DataFrame:
    return R.chunks(spark, sf).select("chunk_id", surrogate(F.col("file_path"), F.col("language"), F.col("symbol_kind"), F.col("symbol_name"), F.col("qualified_name"), F.col("content")).alias("surrogate"))


def surrogate(path, language, kind, name, qualified, content):
    """Labelled lines of a chunk's fields; empty ones are left out."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    return F.concat_ws("\n", line("path", path), line("language", language), line("kind", kind), line("symbol", name), line("qualified", qualified), line("anchors", F.array_join(T.anchors(content), " ")))


def anchors(spark, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(T.anchors(F.col("text")), " ").alias("anchors"))


def token_estimate(spark, sf: str) -> DataFrame:
    """Stored counts where there are any, estimates where not: of French texts none is stored."""
    stored = F.when(F.col("lang") != "fr", F.col("n_chars"))
    return _docs(spark, sf).select("doc_id", T.estimate_tokens(F.col("text"), stored).alias("tokens"))


def line_counts(spark, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.line_count(F.col("text")).alias("lines"))


def embedding_text(spark, sf: str) -> DataFrame:
    t = R.turns(spark, sf)
    crumb = T.breadcrumbs(F.col("file_path"), F.col("qualified_name"), F.col("kind"), T.parent_name(F.col("qualified_name")), F.lit(None).cast("string"))
    return t.select("file_path", "turn", F.concat_ws("\n", F.when(crumb != "", crumb), "content").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (expand_identifiers, compound_split, query_terms, path_terms, symbol_terms, keywords, intent_classify, intent_weights, architecture_question, file_to_module, path_flags, file_scan, breadcrumbs, surrogate_text, anchors, token_estimate, line_counts, embedding_text)
}


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def camel(x: str) -> str:
    """Camel borders by group replacement, as RE2 has no look-around."""
    a = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    b = f"regexp_replace({a}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array({b}, '[ _]+'), lambda p: p <> '')"


def split_compound(x: str) -> str:
    snake = f"list_filter(string_split({x}, '_'), lambda p: p <> '')"
    return f"case when contains({x}, '_') and len({snake}) > 1 then list_concat([{x}], {snake}) when not contains({x}, '_') and len({camel(x)}) > 1 then list_concat([{x}], list_transform({camel(x)}, lambda p: lower(p))) else [{x}] end"


def pairs(x: str) -> str:
    return f"list_transform(range(1, greatest(1, len({x}))::bigint), lambda i: {x}[i] || '_' || {x}[i + 1])"


_S = "said as (select conv_id, turn, 'get' || role || ' ' || 'http' || upper(role[1]) || role[2:] || ' session_' || role || ' ' || text as text from conversations)"
_N = f"names as (select doc_id, {_NAMES} || ' ' || text as text from documents)"
_SYN = "map {" + ", ".join(f"'{k}': {sorted(v.split())}" for k, v in sorted(T.SYNONYMS.items())) + "}"
_ASKED = "asked as (select source, no, case when q = '' then '' else q || ' ' || source end as question from (select distinct source from documents), (values " + ", ".join(f"({k}, '{q}')" for k, q in enumerate(_QUESTIONS)) + ") t(no, q))"
_INTENT = f"""intents as (select source, no, case
  when regexp_matches(lower(question), '{I.PATTERNS["definition_lookup"]}') then 'definition_lookup' when regexp_matches(lower(question), '{I.PATTERNS["debugging"]}') then 'debugging'
  when regexp_matches(lower(question), '{I.PATTERNS["usage_search"]}') then 'usage_search'
  when len(regexp_extract_all(question, '{I.IDENTIFIER}')) > 0 and len(regexp_extract_all(question, '{I.IDENTIFIER}')) >= len({R.blanks("question")}) * 0.2::double then 'definition_lookup'
  when regexp_matches(lower(question), '{I.PATTERNS["architecture_broad"]}') then 'architecture_broad' else 'general' end as intent from asked)"""
_WEIGHTS = "(values " + ", ".join(f"('{k}', {', '.join(f'{x}::double' for x in v)})" for k, v in I.WEIGHTS.items()) + ") w(intent, w_relevance, w_structural, w_type, w_cohesion)"
_PATHS = """paths as (select doc_id, unnest(['src/' || source || '/' || lang || '/mod' || doc_id || '.py', 'lib/' || source || '/__init__.py', 'tests/' || source || '/test_' || doc_id || '.ts',
  'web/' || lang || '/index.js', source || '/node_modules/x/' || doc_id || '.go', source || '/README.md']) as path from documents)"""
_LANG = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "}"
_LANG_OF = f"({_LANG})[lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1))]"
_DIR = "case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end"
_CRUMB = "'module: ' || replace(regexp_replace(file_path, '\\.[^./]+$', ''), '/', '.') || ' > class: ' || split_part(qualified_name, '.', 1) || ' > ' || kind || ': ' || split_part(qualified_name, '.', 2)"
_W3 = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')"
_W4 = "list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}'), lambda w: lower(w))"





SQL = {
    "expand_identifiers": f"""with {_N}, p as (select doc_id, text, list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(list_filter({_W3}, lambda n: len({camel("n")}) > 1), lambda n: {camel("n")})), lambda p: lower(p)), lambda p: len(p) > 1))) as p from names)
select doc_id, case when len(p) > 0 then text || chr(10) || array_to_string(p, ' ') else text end as expanded from p""",
    "compound_split": f"with t as (select doc_id, unnest(string_split({_NAMES}, ' ')) as token from documents) select doc_id, token, array_to_string({split_compound('token')}, ' ') as parts from t",
    "query_terms": f"""with {_S}, a as (select conv_id, turn, list_filter(list_transform(flatten(list_transform(list_filter({_W3}, lambda w: lower(w) not in {_in(T.QUERY_STOP)}), lambda w: {split_compound("w")})), lambda p: lower(p)), lambda p: len(p) >= 3 and p not in {_in(T.QUERY_STOP)}) as f from said),
b as (select conv_id, turn, list_distinct(list_concat(f, {pairs("f")})) as f from a)
select conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(f, flatten(list_transform(list_filter(f, lambda t: ({_SYN})[t] is not null), lambda t: ({_SYN})[t]))))), ' ') as terms from b""",
    "path_terms": f"""with {_S}, a as (select conv_id, turn, list_filter({_W4}, lambda w: w not in {_in(T.PATH_NOISE)}) as k from said),
b as (select conv_id, turn, list_concat(k, flatten(list_transform(k, lambda w: list_transform(list_filter({T.SUFFIXES}, lambda s: ends_with(w, s) and len(w) - len(s) >= 4), lambda s: w[:len(w) - len(s)])))) as k from a)
select conv_id, turn, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(k), lambda t: {{'n': -len(t), 't': t}})), lambda x: x.t), ' '), '') as terms from b""",
    "symbol_terms": f"""with {_S}, a as (select conv_id, turn, list_filter(list_transform({_W3}, lambda w: lower(w)), lambda w: w not in {_in(T.SYMBOL_NOISE)}) as k from said),
b as (select conv_id, turn, unnest(list_concat({pairs("k")}, list_filter(k, lambda w: len(w) >= 6))) as t, generate_subscripts(list_concat({pairs("k")}, list_filter(k, lambda w: len(w) >= 6)), 1) as i from a),
e as (select conv_id, turn, string_agg(t, ' ' order by i) as terms from (select conv_id, turn, t, min(i) as i from b group by all) group by all)
select conv_id, turn, coalesce(terms, '') as terms from said left join e using (conv_id, turn)""",
    "keywords": f"""with {_S}, b as (select conv_id, turn, unnest(k) as t, generate_subscripts(k, 1) as i from (select conv_id, turn, list_filter(list_transform({_W3}, lambda w: lower(w)), lambda w: w not in {_in(T.SEARCH_STOP | T.QUERY_STOP)}) as k from said)),
e as (select conv_id, turn, string_agg(t, ' ' order by i) as k from (select conv_id, turn, t, min(i) as i from b group by all) group by all)
select conv_id, turn, coalesce(k, '') as keywords from said left join e using (conv_id, turn)""",
    "intent_classify": f"with {_ASKED}, {_INTENT} select source, no, intent from intents",
    "intent_weights": f"with {_ASKED}, {_INTENT} select source, no, intent, w_relevance, w_structural, w_type, w_cohesion from intents join {_WEIGHTS} using (intent)",
    "architecture_question": f"with {_ASKED} select source, no, " + " or ".join(f"contains(lower(question), '{k}')" for k in sorted(T.SYNONYMS)) + " as is_architecture from asked",
    "file_to_module": f"with {_PATHS} select doc_id, path, replace(regexp_replace(regexp_replace(regexp_replace(path, '^(src|lib|app)/', ''), '\\.[^./]+$', ''), '/(__init__|index)$', ''), '/', '.') as module from paths",
    "path_flags": f"""with {_PATHS} select doc_id, path, {_LANG_OF} as language, starts_with(lower(path), 'test') or contains(lower(path), '/test') as is_test, regexp_extract(path, '[^/]*$') in {_in(T.ENTRY_POINTS)} as is_entry,
list_contains(string_split(path, '/'), 'node_modules') or regexp_matches(path, '(^|/)README[.]md$') as ignored, {_DIR} as directory from paths""",
    "file_scan": f"with {_PATHS} select doc_id, path, {_LANG_OF} as language from paths where {_LANG_OF} is not null and not list_contains(string_split(path, '/'), 'node_modules')",
    "breadcrumbs": R.with_(R.TURNS) + f" select file_path, turn, {_CRUMB} as breadcrumbs from turns",
    "surrogate_text": R.with_(R.CHUNKS) + f""", w as (select chunk_id, unnest({_W3.replace("text", "content")}) as w, generate_subscripts({_W3.replace("text", "content")}, 1) as i from chunks),
a as (select chunk_id, string_agg(w, ' ' order by i) as anchors from (select *, row_number() over (partition by chunk_id order by i) as r from (select chunk_id, w, min(i) as i from w group by all)) where r <= 8 group by 1)
select chunk_id, concat_ws(chr(10), 'path: ' || file_path, 'language: ' || language, 'kind: ' || symbol_kind, 'symbol: ' || symbol_name, 'qualified: ' || qualified_name, 'anchors: ' || anchors) as surrogate from chunks left join a using (chunk_id)""",
    "anchors": f"""with w as (select doc_id, unnest({_W3}) as w, generate_subscripts({_W3}, 1) as i from documents),
a as (select doc_id, string_agg(w, ' ' order by i) as anchors from (select *, row_number() over (partition by doc_id order by i) as r from (select doc_id, w, min(i) as i from w group by all)) where r <= 8 group by 1)
select doc_id, coalesce(anchors, '') as anchors from documents left join a using (doc_id)""",
    "token_estimate": f"select doc_id, case when lang <> 'fr' and n_chars > 0 then n_chars else floor(len({R.blanks('text')}) * 1.3::double)::bigint end as tokens from documents",
    "line_counts": "select doc_id, case when text = '' then 0 else len(text) - len(replace(text, chr(10), '')) + case when ends_with(text, chr(10)) then 0 else 1 end end::bigint as lines from documents",
    "embedding_text": R.with_(R.TURNS) + f" select file_path, turn, {_CRUMB} || chr(10) || content as text from turns",
}
