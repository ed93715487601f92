"""Structure of code: patterns, interfaces, decisions, statistics, comparison.

symbols: file_path, name, kind, parent, visibility, signature, start_line, end_line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .lexical import BROADCAST_TERMS, _small

DIMENSIONS = {
    "api_surface": "api endpoint route handler controller view resource",
    "concurrency": "async thread lock queue pool concurrent parallel",
    "configuration": "config settings env environment options configuration",
    "error_handling": "error_handler custom_exception exception error result_type",
    "state_management": "singleton repository registry cache store state session",
    "testing": "test fixture mock assert spec setup teardown",
}
PATTERNS = ["event_bus", "middleware_chain", "plugin_system", "repository", "strategy"]


def _arr(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def _named(name: Column, words: str) -> Column:
    return F.exists(_arr(words), lambda w: F.contains(F.lower(name), w))


def confidence(evidence: Column) -> Column:
    return F.when(evidence >= 3, 0.85).when(evidence == 2, 0.60).when(evidence == 1, 0.30).otherwise(0.0)


def classes(symbols: DataFrame) -> DataFrame:
    """(file_path, name, top, methods, all_methods): each class with its public methods in lower case, and all of them as written."""
    m = symbols.where("kind = 'method'").groupBy("file_path", F.col("parent").alias("name")).agg(F.array_sort(F.collect_set(F.when(F.col("visibility") == "public", F.lower("name")))).alias("methods"), F.array_sort(F.collect_set("name")).alias("all_methods"))
    c = symbols.where("kind = 'class'").select("file_path", "name", F.col("parent").isNull().alias("top")).distinct()
    none = F.array().cast("array<string>")
    return c.join(m, ["file_path", "name"], "left").select("file_path", "name", "top", F.coalesce("methods", none).alias("methods"), F.coalesce("all_methods", none).alias("all_methods"))


def _any(methods: str, words: str) -> Column:
    return F.arrays_overlap(F.col(methods), _arr(words))


def middleware_chain(c: DataFrame) -> DataFrame:
    full = _any("methods", "set_next next") & _any("methods", "process handle")
    chain = c.groupBy("file_path").agg(F.max(full).alias("chain"))
    x = c.withColumn("full", full).join(_small(chain, BROADCAST_TERMS), "file_path")
    part = _any("methods", "process handle") & (_named(F.col("name"), "middleware handler chain filter interceptor") | F.col("chain"))
    return x.where(F.col("full") | part).select("file_path", "name", F.when(F.col("full"), "chain").otherwise("participant").alias("role"))


def plugin_system(c: DataFrame) -> DataFrame:
    registry = _any("methods", "register unregister") & (_any("methods", "get all") | _named(F.col("name"), "registry manager store"))
    contract = F.col("top") & _named(F.col("name"), "plugin extension handler")
    return c.where(registry | contract).select("file_path", "name", F.when(registry, "registry").otherwise("contract").alias("role"))


def event_bus(c: DataFrame) -> DataFrame:
    sub = F.array_intersect("methods", _arr("subscribe on listen add_listener add_handler"))
    emits = _any("methods", "emit publish dispatch trigger fire send")
    vague = (sub == _arr("on")) & ~_named(F.col("name"), "event bus emitter dispatcher listener")
    has = F.size(sub) > 0
    return c.where(~vague & (has | emits)).select("file_path", "name", F.when(has & emits, "bus").when(has, "subscriber").otherwise("emitter").alias("role"))


def repository(c: DataFrame) -> DataFrame:
    n = F.size(F.array_intersect("methods", _arr("get find save create update delete all list fetch")))
    return c.where((n >= 3) | ((n >= 2) & _named(F.col("name"), "repo repository dao store data"))).select("file_path", "name", F.lit("repository").alias("role"))


def strategy(c: DataFrame) -> DataFrame:
    """Classes of one file that share a public method: a protocol or a context by name, concrete ones by the method."""
    own = F.filter("all_methods", lambda m: ~(m.startswith("__") & m.endswith("__")))
    c = c.withColumn("own", own)
    public = F.filter("methods", lambda m: ~(m.startswith("__") & m.endswith("__")))
    # rows, not lists: a file may have any number of classes
    uses = c.select("file_path", "name", F.explode(public).alias("m")).distinct()
    shared = materialize(uses.groupBy("file_path", "m").agg(F.count("name").alias("n")).where("n >= 2").select("file_path", "m"), "shared")
    sharing = uses.join(_small(shared, BROADCAST_TERMS), ["file_path", "m"], "left_semi").select("file_path", "name").distinct().withColumn("shares", F.lit(True))
    x = c.join(_small(shared.select("file_path").distinct(), BROADCAST_TERMS), "file_path", "left_semi").join(sharing, ["file_path", "name"], "left")
    context = _named(F.col("name"), "context executor runner engine sorter dispatcher") & (F.size("own") >= 1)
    protocol = _named(F.col("name"), "strategy policy algorithm interface protocol") & (F.size("own") <= 3)
    role = F.when(context, "context").when(protocol, "protocol").when(F.col("shares"), "concrete")
    x = materialize(x.select("file_path", "name", "methods", "own", role.alias("role")), "roles")
    has = lambda r: F.max(F.coalesce(F.col("role") == r, F.lit(False)))
    names = x.where("role = 'protocol'").select("file_path", F.explode("own").alias("m")).distinct().groupBy("file_path").agg(F.collect_list("m").alias("pm"))
    files = x.groupBy("file_path").agg(has("protocol").alias("p"), has("concrete").alias("k"), has("context").alias("c")).join(names, "file_path", "left")
    x = x.join(_small(files, BROADCAST_TERMS), "file_path")
    late = F.col("role").isNull() & F.col("p") & ~F.col("k") & F.arrays_overlap("methods", "pm")
    x = x.withColumn("role", F.when(late, "concrete").otherwise(F.col("role"))).drop("k")
    x = x.join(_small(x.groupBy("file_path").agg(has("concrete").alias("k")), BROADCAST_TERMS), "file_path")
    return x.where("role is not null and k and (p or c)").select("file_path", "name", "role")


def patterns(symbols: DataFrame, detectors: dict | None = None) -> DataFrame:
    """(pattern, file_path, name, role) of all detectors, which are functions of classes(); more can be given."""
    c = materialize(classes(symbols), "classes")  # every detector reads it, some several times
    found = {"middleware_chain": middleware_chain, "plugin_system": plugin_system, "event_bus": event_bus, "repository": repository, "strategy": strategy} | (detectors or {})
    out = None
    for name, f in sorted(found.items()):
        x = f(c).select(F.lit(name).alias("pattern"), "file_path", "name", "role")
        out = x if out is None else out.unionByName(x)
    return out


def catalog(found: DataFrame) -> DataFrame:
    """(pattern, evidence, confidence)."""
    g = found.groupBy("pattern").agg(F.count("*").alias("evidence"))
    return g.select("pattern", "evidence", confidence(F.col("evidence")).alias("confidence"))


_ADVICE = {
    "event_bus": ("direct calls between components, a message queue", "publishers do not know subscribers; the order of delivery is not fixed"),
    "middleware_chain": ("decorators around one handler, a pipeline of functions", "steps are added one by one; their order is explicit"),
    "plugin_system": ("configuration flags, subclassing one core class", "features come from outside; the contract has to stay stable"),
    "repository": ("active records, queries where data is used", "storage can be exchanged; tests need no database"),
    "strategy": ("branches on a type, a table of functions", "algorithms are exchanged at run time; callers know only the interface"),
}


def decisions(cat: DataFrame, least: float = 0.5) -> DataFrame:
    """(decision, alternatives, implications, evidence) of patterns of at least that confidence; literal tables by pattern."""
    t = cat.sparkSession.createDataFrame([(k, *v) for k, v in _ADVICE.items()], "pattern string, alternatives string, implications string")
    return cat.where(F.col("confidence") >= least).join(F.broadcast(t), "pattern", "left").select(F.concat(F.lit("uses "), F.replace("pattern", F.lit("_"), F.lit(" "))).alias("decision"), F.coalesce("alternatives", F.lit("")).alias("alternatives"), F.coalesce("implications", F.lit("")).alias("implications"), "evidence")


def interfaces(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, name, kind, signature, used_by): public symbols of the top level, private names but for dunders left out."""
    n = F.col("name")
    public = (F.col("visibility") == "public") & F.col("kind").isin("function", "class", "interface") & F.col("parent").isNull() & (~n.startswith("_") | (n.startswith("__") & n.endswith("__")))
    used = edges.groupBy(F.col("target").alias("file_path")).agg(F.array_sort(F.collect_set("source")).alias("used_by"))
    return symbols.where(public).join(used, "file_path", "left").select("file_path", "name", "kind", "signature", F.coalesce("used_by", F.array().cast("array<string>")).alias("used_by"))


def return_type(signature: Column) -> Column:
    return F.when(signature.contains("->"), F.regexp_replace(F.trim(F.substring_index(signature, "->", -1)), r"\s*:?$", ""))


def parameters(signature: Column) -> Column:
    """array(struct(name, type, default, required)): the parameters between the outer parentheses, cut at commas outside brackets; self and cls are left out.

    The cut is a fold over the characters that counts open brackets; it stays in the JVM.
    """
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    chars = F.split(inner, "")
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        d = a["d"] + F.when(c.isin("[", "(", "{"), 1).when(c.isin("]", ")", "}"), -1).otherwise(0)
        cut = (c == ",") & (a["d"] == 0)
        return F.struct(d.alias("d"), F.when(cut, "").otherwise(F.concat(a["cur"], c)).alias("cur"), F.when(cut, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"))

    parts = F.aggregate(chars, start, step, lambda a: F.concat(a["out"], F.array(a["cur"])))
    trimmed = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin("*", "/", "*args", "**kwargs"))
    rx = r"(?s)^\**\s*([A-Za-z_]\w*)\s*(?::\s*([^=]*?))?\s*(?:=\s*(.*))?$"

    def one(p: Column) -> Column:
        got = lambda k: F.nullif(F.trim(F.regexp_extract(p, rx, k)), F.lit(""))
        return F.struct(got(1).alias("name"), got(2).alias("type"), got(3).alias("default"), (got(3).isNull() & ~p.startswith("*")).alias("required"))

    return F.filter(F.transform(trimmed, one), lambda x: x["name"].isNotNull() & ~x["name"].isin("self", "cls"))


def stats(files: DataFrame) -> DataFrame:
    """(language, files, lines, symbols, percent): by language and, with a null language, over all; files (language, lines, symbols)."""
    g = files.rollup("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("symbols").alias("symbols"))
    total = F.max("files").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("percent", F.round(100.0 * F.col("files") / total, 2))


def compare(evidence: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """(dimension, n_a, n_b, approach_a, approach_b, trade_off) of evidence (side 'a' or 'b', text): texts that have a dimension's words."""
    unknown = set(dimensions or []) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"unknown dimensions: {', '.join(sorted(unknown))}")
    spark = evidence.sparkSession
    dims = spark.createDataFrame([(d, DIMENSIONS[d].split()) for d in sorted(dimensions or DIMENSIONS)], "dimension string, words array<string>")
    hits = evidence.join(F.broadcast(dims), F.exists("words", lambda w: F.contains(F.lower("text"), w)))
    counts = hits.groupBy("dimension").pivot("side", ["a", "b"]).agg(F.count(F.lit(1)))
    x = dims.select("dimension").join(counts, "dimension", "left").select("dimension", F.coalesce("a", F.lit(0)).alias("n_a"), F.coalesce("b", F.lit(0)).alias("n_b"))
    a, b = F.col("n_a"), F.col("n_b")
    trade = F.when((a == 0) & (b == 0), "neither").when(a == 0, "only b").when(b == 0, "only a").when(a > 2 * b, "a far ahead").when(b > 2 * a, "b far ahead").otherwise("comparable")
    say = lambda n: F.when(n == 0, "none found").otherwise(F.concat(n, F.lit(" found")))
    return x.select("dimension", "n_a", "n_b", say(a).alias("approach_a"), say(b).alias("approach_b"), trade.alias("trade_off"))


# browsing


def file_tree(files: DataFrame, max_depth: int = 5) -> DataFrame:
    """(path, parent, depth, is_directory, files, lines): every file (path, lines) and every directory above it down to a depth."""
    parts = F.split("path", "/")
    up = F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")
    x = files.select("path", "lines", parts.alias("parts"), up)
    x = x.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"), F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/").alias("parent"), "depth", (F.col("depth") < F.size("parts")).alias("is_directory"), "lines")
    return x.where(F.col("depth") <= max_depth).groupBy("path", "parent", "depth", "is_directory").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def outline(symbols: DataFrame) -> DataFrame:
    """symbols (file_path, qualified_name, ...) with parent_name, the qualified name above where the file has such a symbol."""
    from ..functions.text import parent_name

    s = symbols.withColumn("above", parent_name(F.col("qualified_name")))
    names = symbols.select("file_path", F.col("qualified_name").alias("above")).distinct().withColumn("parent_name", F.col("above"))
    return s.join(names, ["file_path", "above"], "left").drop("above")


def symbols_batch(symbols: DataFrame, wanted: list[str], most: int = 50) -> DataFrame:
    """The wanted symbol ids in their order, nulls where missing; asking for more than `most` is an error."""
    if len(wanted) > most:
        raise ValueError(f"at most {most} symbols at once")
    w = symbols.sparkSession.createDataFrame(list(enumerate(wanted)), "pos int, symbol_id string")
    return F.broadcast(w).join(symbols, "symbol_id", "left").orderBy("pos")


def token_totals(chunks: DataFrame) -> DataFrame:
    """(file_path, tokens, chunks): by file and, with a null path, over all."""
    return chunks.rollup("file_path").agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.count("*").alias("chunks"))
