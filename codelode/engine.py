"""From a folder of source files to answers: an index in a Store, and questions asked of it, many in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import analyze, assemble, chunking, graph, lexical, render
from .sources import files as sources
from .sources import parse
from .sources.store import Store
from .storage import materialize, spread

FIELDS = ["content", "symbol_name", "file_path"]


def index_repository(spark: SparkSession, root: str, folder: str, languages: list[str] | None = None) -> Store:
    """Scans, parses, resolves and chunks the files under root, and writes files, symbols, imports, edges, chunks and centrality to a store in `folder`, all at once.

    Files that don't parse have chunks, but no symbols, and parse_error true.
    """
    found = materialize(spread(sources.scan(spark, root, languages)), "scanned")
    parsed = materialize(parse.parse(found), "parsed")
    symbols, resolved = parse.symbols(parsed), materialize(parse.resolve(parse.imports(parsed), found), "resolved")
    edges = materialize(resolved.where("resolved_path is not null").select(F.col("file_path").alias("source"), F.col("resolved_path").alias("target")).distinct(), "edges")
    texts = found.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("content"), "language")
    chunks = chunking.chunk_files(texts.select("file_path", "content"), symbols.select("file_path", F.col("qualified_name").alias("name"), "start_line", "end_line"))
    # of symbols of one name in a file the first
    first = Window.partitionBy("file_path", "qualified_name").orderBy("start_line", "kind")
    kinds = symbols.withColumn("r", F.row_number().over(first)).where("r = 1").select("file_path", F.col("qualified_name").alias("symbol"), F.col("kind").alias("symbol_kind"), "visibility")
    chunks = chunks.join(kinds, ["file_path", "symbol"], "left").join(texts.select("file_path", "language"), "file_path")
    chunks = chunks.select("chunk_id", "file_path", "language", F.col("symbol").alias("symbol_name"), F.col("symbol").alias("qualified_name"), F.coalesce("symbol_kind", F.lit("module")).alias("symbol_kind"), "visibility", "start_line", "end_line", "token_count", "content")
    facts = parsed.select(F.col("path").alias("file_path"), "language", "lines", F.size("symbols").alias("symbols"), "parse_error").join(found.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("hash")), "file_path")
    store = Store(spark, folder)
    store.write({"source": root}, files=facts, symbols=symbols, imports=resolved, edges=edges, chunks=chunks, centrality=graph.pagerank(edges))
    return store


def boosted_search(chunks: DataFrame, questions: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, chunk_id, file_path, score, rank): lexical search, with chunks added whose path or symbol has a word of the question."""
    words = chunks.withColumn("content", T.expand_identifiers(F.coalesce("content", F.lit(""))))
    hits = materialize(lexical.search(words, questions, FIELDS, k), "hits")
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    terms = lambda words: questions.select("query_id", F.posexplode(words(F.col("question"))).alias("pos", "word"))
    paths = lexical.path_boost(chunks, terms(T.path_terms), hits, best)
    names = lexical.symbol_seeds(chunks, terms(T.symbol_terms), best).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = hits.select("query_id", "chunk_id", "score").unionByName(paths).unionByName(names).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return lexical.top(both.join(chunks.select("chunk_id", "file_path"), "chunk_id"), k).select("query_id", "chunk_id", "file_path", "score", "rank")


def query(store: Store, questions: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, place, chunk_id, file_path, final, used) for questions (query_id, question, budget)."""
    chunks = store.table("chunks")
    hits = materialize(boosted_search(chunks, questions, k), "hits")
    return assemble.assemble(hits, store.table("edges"), chunks, questions, centrality=store.table("centrality"))


def answer(store: Store, questions: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, markdown, xml, json) of the bundles."""
    items = render.bundles(query(store, questions, k), store.table("chunks"))
    return items.select("query_id", render.as_markdown(F.col("items")).alias("markdown"), render.as_xml(F.col("items")).alias("xml"), render.as_json(F.col("items")).alias("json"))


def profile(store: Store) -> dict[str, DataFrame]:
    """Statistics, interfaces, patterns and decisions of a repository, by name."""
    symbols = store.table("symbols")
    catalog = analyze.catalog(analyze.patterns(symbols))
    return {"stats": analyze.stats(store.table("files")), "interfaces": analyze.interfaces(symbols, store.table("edges")), "patterns": catalog, "decisions": analyze.decisions(catalog)}
