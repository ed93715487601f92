"""From files and symbols to chunks: greedy line packing, the lines between symbols, merging, ids.

Folds run in one row each, as built-in higher-order functions whose accumulators hold only what has been decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_estimate

MAX_TOKENS, MIN_TOKENS = 500, 50


def pack_starts(tokens: Column, most: int = MAX_TOKENS) -> Column:
    """First lines (from 1) of the groups: a line that would exceed `most` begins a new one; a longer line stays whole."""
    start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("s"))

    def step(a: Column, t: Column) -> Column:
        i, new = a["i"] + 1, (a["i"] == 0) | (a["t"] + t > most)
        return F.struct(F.when(new, t).otherwise(a["t"] + t).alias("t"), i.alias("i"), F.when(new, F.concat(a["s"], F.array(i))).otherwise(a["s"]).alias("s"))

    return F.aggregate(tokens, start, step, lambda a: a["s"])


def line_pack(files: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """(id, part, start_line, end_line, token_count, content) of files (id, content); lines end at newlines."""
    lines = files.select("id", F.split("content", "\n").alias("lines"))
    counted = lines.select("id", "lines", F.transform("lines", lambda x: word_estimate(x)).alias("t"))
    parts = counted.select("id", "lines", "t", pack_starts(F.col("t"), most).alias("starts"))
    each = parts.select("id", "lines", "t", "starts", F.posexplode("starts").alias("part", "start_line"))
    end = F.coalesce(F.get("starts", F.col("part") + 1) - 1, F.size("lines"))
    n = F.col("end_line") - F.col("start_line") + 1
    return each.withColumn("end_line", end).select("id", "part", "start_line", "end_line", F.aggregate(F.slice("t", F.col("start_line"), n), F.lit(0).cast("long"), lambda a, x: a + x).alias("token_count"), F.array_join(F.slice("lines", F.col("start_line"), n), "\n").alias("content"))


def uncovered(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, start_line, end_line): lines of files (file_path, total_lines) that no symbol (file_path, start_line, end_line) covers."""
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    s = symbols.select("file_path", "start_line", "end_line").withColumn("reach", F.coalesce(F.max("end_line").over(w), F.lit(0)))
    gaps = s.where("start_line > reach + 1").select("file_path", (F.col("reach") + 1).alias("start_line"), (F.col("start_line") - 1).alias("end_line"))
    last = files.join(symbols.groupBy("file_path").agg(F.max("end_line").alias("last")), "file_path", "left").select("file_path", "total_lines", F.coalesce("last", F.lit(0)).alias("last"))
    tail = last.where("last < total_lines").select("file_path", (F.col("last") + 1).alias("start_line"), F.col("total_lines").alias("end_line"))
    return gaps.union(tail)


def merge_small(candidates: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """(file_path, place, start_line, symbol, token_count, pieces): candidates (file_path, pos, start_line, symbol, token_count) after merging.

    One of fewer than `least` tokens and without a symbol goes forward into the next without a symbol, else back into
    the last result without one. pieces are the positions that a result is made of. Token counts add up.
    """
    item = "struct<start_line:bigint,symbol:string,t:bigint,pieces:array<int>>"
    row = F.struct("pos", F.col("start_line").cast("long").alias("start_line"), "symbol", F.col("token_count").cast("long").alias("t"))
    g = candidates.groupBy("file_path").agg(F.sort_array(F.collect_list(row)).alias("c"))
    start = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.lit(None).cast(item).alias("held"))
    small = lambda x: x["symbol"].isNull() & (x["t"] < least)
    add = lambda a, b: F.struct(a["start_line"].alias("start_line"), F.lit(None).cast("string").alias("symbol"), (a["t"] + b["t"]).alias("t"), F.concat(a["pieces"], b["pieces"]).alias("pieces"))

    def put(out: Column, x: Column) -> Column:
        """x joins the results; a small one goes back into the last, if that has no symbol."""
        last = F.try_element_at(out, F.lit(-1))
        back = small(x) & last.isNotNull() & last["symbol"].isNull()
        return F.when(back, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(add(last, x)))).otherwise(F.concat(out, F.array(x)))

    def step(a: Column, c: Column) -> Column:
        x = F.struct(c["start_line"].alias("start_line"), c["symbol"].alias("symbol"), c["t"].alias("t"), F.array(c["pos"]).alias("pieces"))
        held = a["held"]
        # what is held is small: it joins a next one without a symbol, else it is put
        now = F.when(held.isNotNull() & x["symbol"].isNull(), add(held, x)).otherwise(x)
        out = F.when(held.isNotNull() & x["symbol"].isNotNull(), put(a["out"], held)).otherwise(a["out"])
        return F.when(small(now), F.struct(out.alias("out"), now.alias("held"))).otherwise(F.struct(F.concat(out, F.array(now)).alias("out"), F.lit(None).cast(item).alias("held")))

    merged = g.select("file_path", F.aggregate("c", start, step, lambda a: F.when(a["held"].isNotNull(), put(a["out"], a["held"])).otherwise(a["out"])).alias("m"))
    return merged.select("file_path", F.posexplode("m").alias("place", "x")).select("file_path", "place", "x.start_line", "x.symbol", F.col("x.t").alias("token_count"), "x.pieces")


def disambiguated(ids: DataFrame, symbol_id: str = "symbol_id", order: str = "start_line") -> DataFrame:
    """ids with the second and later rows of a symbol id, in order of line, marked @2, @3 and so on."""
    n = F.row_number().over(Window.partitionBy("file_path", symbol_id).orderBy(order))
    return ids.withColumn(symbol_id, F.when(n > 1, F.concat(F.col(symbol_id), F.lit("@"), n)).otherwise(F.col(symbol_id)))


def import_relevant(content: Column, module: Column, names: Column, alias: Column) -> Column:
    """Whether a text has an import's alias, one of its names, or, of an import without names, the last part of its module."""
    named = F.exists(names, lambda s: F.contains(content, s))
    last = F.contains(content, F.element_at(F.split(module, "[.]"), -1))
    return F.coalesce(F.contains(content, F.when(alias != "", alias)), F.lit(False)) | F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, named).otherwise(last)


def format_import(module: Column, names: Column, alias: Column) -> Column:
    tail = F.when(F.coalesce(alias, F.lit("")) != "", F.concat(F.lit(" as "), alias)).otherwise("")
    few = F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0
    return F.when(few, F.concat(F.lit("from "), module, F.lit(" import "), F.array_join(names, ", "), tail)).otherwise(F.concat(F.lit("import "), module, tail))


def chunk_files(files: DataFrame, symbols: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """(file_path, chunk_id, symbol, start_line, end_line, token_count, content) of files (file_path, content) and symbols (file_path, name, start_line, end_line).

    Symbols' lines, then the lines between them, blank stretches dropped, cut to `most` tokens, small ones without a
    symbol merged. A class's lines hold its methods', which are chunks of their own as well. Lines of merged pieces
    that don't touch count as if they did, so such a chunk's end line can fall short.
    """
    total = files.select("file_path", F.size(F.split("content", "\n")).alias("total_lines"))
    gaps = uncovered(symbols, total).select("file_path", F.lit(None).cast("string").alias("symbol"), "start_line", "end_line", F.lit(1).alias("kind"))
    spans = symbols.select("file_path", F.col("name").alias("symbol"), "start_line", "end_line", F.lit(0).alias("kind")).union(gaps)
    text = files.select("file_path", F.split("content", "\n").alias("lines"))
    cut = spans.join(text, "file_path").select("file_path", "symbol", "start_line", "kind", F.array_join(F.slice("lines", F.greatest(F.col("start_line"), F.lit(1)).cast("int"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n").alias("content"))
    cut = cut.where(F.trim(F.regexp_replace("content", r"[\n\r\t]", "")) != "")
    parts = line_pack(cut.select(F.struct("file_path", "symbol", "start_line", "kind").alias("id"), "content"), most)
    c = parts.select("id.file_path", "id.symbol", "id.kind", (F.col("id.start_line") + F.col("start_line") - 1).cast("long").alias("start_line"), "token_count", "content")
    w = Window.partitionBy("file_path").orderBy("kind", "start_line", F.coalesce("symbol", F.lit("")))
    c = c.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    m = merge_small(c, least)
    pieces = m.select("file_path", "place", F.col("start_line").alias("first"), F.posexplode("pieces").alias("k", "pos")).join(c, ["file_path", "pos"])
    out = pieces.groupBy("file_path", "place", "first").agg(F.max("symbol").alias("symbol"), F.sum("token_count").alias("token_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), "\n").alias("content"))
    out = out.where(F.trim(F.regexp_replace("content", r"[\n\r\t]", "")) != "")
    end = F.col("first") + F.size(F.split("content", "\n")) - 1
    return out.select("file_path", F.concat_ws(":", "file_path", F.coalesce("symbol", F.lit("_module")), F.col("first").cast("string")).alias("chunk_id"), "symbol", F.col("first").alias("start_line"), end.alias("end_line"), "token_count", "content")
