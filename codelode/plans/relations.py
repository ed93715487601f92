"""The engine's relations as views of the driver's tables, in Spark and in SQL. Every one covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_estimate
from ..storage import materialize, spread

#: Text fields of a chunk that the queries search.
FIELDS = ["content", "file_path"]
#: Tables whose rows take long.
TEXTS = {"documents", "pages", "conversations", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def doc_path() -> F.Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each document; its kind goes by its language, its name by its source."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "class").when(F.col("lang") == "de", "interface").otherwise("function")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        doc_path().alias("file_path"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        kind.alias("symbol_kind"),
        F.concat("lang", F.lit("_"), "source").alias("symbol_name"),
        F.concat("source", F.lit("."), "lang", F.lit("."), "doc_id").alias("qualified_name"),
        word_estimate(F.col("text")).alias("token_count"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit(8192).cast("long").alias("budget"))


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's file refers to the next one of its source and of its language."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", doc_path().alias("path"))
    by_source = d.select(F.col("path").alias("source_path"), F.lead("path").over(Window.partitionBy("source").orderBy("doc_id")).alias("target"))
    by_lang = d.select(F.col("path").alias("source_path"), F.lead("path").over(Window.partitionBy("source", "lang").orderBy("doc_id")).alias("target"))
    return by_source.union(by_lang).where("target is not null").distinct().select(F.col("source_path").alias("source"), "target")


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target) of every page's links, as often as they occur; pages by their id."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), "page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))
    return p


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("P"), "l_partkey").alias("target")).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.concat(F.lit("label_"), "label").alias("file_path"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of symbols: turns stacked on one another, each as many lines as its text."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations")
    lines = F.size(F.split("text", "\n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    # between turns lie as many lines of no symbol as the turn's number
    end = F.sum(lines + F.col("turn")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.select(
        F.concat(F.lit("conv/"), "conv_id", F.lit(".py")).alias("file_path"),
        "turn",
        F.col("role").alias("kind"),
        F.concat(F.lit("C"), "conv_id", F.lit("."), "role").alias("qualified_name"),
        F.col("text").alias("content"),
        (end - lines + 1).cast("long").alias("start_line"),
        end.cast("long").alias("end_line"),
    )


def saved(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, name)


def six(name: str) -> F.Column:
    """A column to six decimals, by the same operations in both engines; exact halves, which come up, go up even if the last bit differs."""
    return (F.floor(F.col(name) * 1e6 + 0.5001) / 1e6).alias(name)


def few(df: DataFrame) -> DataFrame:
    """A table of a few rows a question, written, and sent to what it is joined with."""
    from ..operators.lexical import BROADCAST_TERMS, _small

    return _small(saved(df, "few"), BROADCAST_TERMS)


def to_six(x: F.Column) -> F.Column:
    """x to six decimals by the operations of SQL's round: halves away from zero, of the product, and what rounds to zero keeps its sign."""
    y = F.abs(x * 1e6)
    whole = F.rint(y)
    return (whole + F.when(y - whole == 0.5, 1.0).otherwise(0.0)) * F.signum(x) / 1e6


# the same in DuckDB


def six_sql(name: str) -> str:
    return f"floor({name} * 1e6::double + 0.5001::double) / 1e6::double as {name}"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def blanks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


DOC_PATH = "source || '/' || lang || '/doc_' || doc_id || '.txt'"
CHUNKS = f"""chunks as (select doc_id as chunk_id, {DOC_PATH} as file_path, text as content, lang as language,
  case lang when 'en' then 'class' when 'de' then 'interface' else 'function' end as symbol_kind, lang || '_' || source as symbol_name,
  source || '.' || lang || '.' || doc_id as qualified_name, floor(len({blanks("text")}) * 1.3::double)::bigint as token_count from documents)"""
QUESTIONS = "questions as (select item_id as query_id, text as question, 8192::bigint as budget from benchmark)"
FILE_EDGES = f"""paths as (select doc_id, source, lang, {DOC_PATH} as path from documents),
edges as (select distinct * from (select path as source, lead(path) over (partition by source order by doc_id) as target from paths
  union all select path, lead(path) over (partition by source, lang order by doc_id) from paths) where target is not null)"""
PAGE_EDGES = """links as (select 'page:' || page_id as source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages)"""
VECTORS = "vectors as (select vec_id as id, embedding::double[] as v, 'label_' || label as file_path from embeddings)"
TURNS = """turns as (select 'conv/' || conv_id || '.py' as file_path, turn, role as kind, 'C' || conv_id || '.' || role as qualified_name, text as content,
  (e - n + 1)::bigint as start_line, e::bigint as end_line
  from (select *, len(string_split(text, chr(10))) as n, sum(len(string_split(text, chr(10))) + turn) over (partition by conv_id order by turn rows unbounded preceding) as e from conversations))"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts)
