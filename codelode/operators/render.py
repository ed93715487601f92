"""Bundles of chunks as text: one row for each question. Bundles are as small as their token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .lexical import BROADCAST_TERMS, _small


def bundles(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, items): array of (place, file_path, content, score), in order, of packed (query_id, place, chunk_id, final)."""
    # few against the chunks, whose texts stay where they are
    x = _small(materialize(packed.select("query_id", "place", "chunk_id", F.col("final").alias("score")), "packed"), BROADCAST_TERMS).join(chunks.select("chunk_id", "file_path", "content"), "chunk_id")
    return x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "file_path", "content", "score"))).alias("items"))


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def as_json(items: Column) -> Column:
    return F.to_json(items)


def as_markdown(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("## "), x["file_path"], F.lit("\n\n```\n"), x["content"], F.lit("\n```"))), "\n\n")


def as_xml(items: Column) -> Column:
    each = F.transform(items, lambda x: F.concat(F.lit('<chunk file="'), _escaped(x["file_path"]), F.lit('">'), _escaped(x["content"]), F.lit("</chunk>")))
    return F.concat(F.lit("<context>"), F.array_join(each, ""), F.lit("</context>"))
