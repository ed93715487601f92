"""Operator 10: exact top-k search by the three-phase uniform threshold algorithm.

Every query (a row of a table of texts) asks for the K documents of highest BM25 score, a sum over its distinct words of
one partial score each. A word's list of partial scores is one node of the algorithm.
Phase one: each list's K best entries are joined to the queries that have the word, and the K documents of best partial sums are
scored exactly: the least of their scores, tau, is at most the K-th best. The cutoff is the largest one at which a document below it in all lists,
each adding less than the cutoff or at most its list's best entry, stays under tau; a list of low entries so takes less than an equal share.
Phase two: all entries at or above the cutoff are collected; a document's sum so far, with the most that each of its
unseen words can add, bounds its score from above, and tau or the K-th best sum so far from below; what cannot reach it goes.
Phase three: the remaining documents' missing scores are looked up, and their exact sums ranked.
Partial scores are whole millionths, so sums are exact whatever their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick
from .textops import buffers, lists, slices, words

K = 10
K1, B = 1.2, 0.75
#: Distinct words of the queries up to which they are sent to the tasks as one array (8 bytes each).
BROADCAST_WORDS = 2_000_000
#: Rows of (query, word, cutoff) up to which they are broadcast.
BROADCAST_ROWS = 500_000


def _counts(vocabulary: np.ndarray | None):
    """(doc_id, dl, terms, tfs) of each document with words: its words that queries have, or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offs = buffers(batch.column(1))
            for i, j in slices(offs):
                h, _, _, first = words(b, offs[i : j + 1])
                dl = np.diff(first)
                has = np.flatnonzero(dl)
                rows = np.repeat(np.arange(len(dl)), dl)
                if vocabulary is not None:
                    code = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                    known = vocabulary[code] == h if len(vocabulary) else np.zeros(len(h), bool)
                    rows, code, names = rows[known], code[known], vocabulary
                else:
                    names, code = np.unique(h, return_inverse=True)
                width = max(1, len(names))
                key, tf = np.unique(rows * width + code, return_counts=True)
                at = np.searchsorted(key // width, np.append(has, len(dl)))
                terms = names[key % width].view(np.int64) if len(key) else np.zeros(0, np.int64)
                ids = batch.column(0).slice(i, j - i).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, pa.array(dl[has]), lists(terms, at, pa.int64()), lists(tf, at, pa.int64())], names=["doc_id", "dl", "terms", "tfs"])

    return run


def _query_words(queries: DataFrame) -> DataFrame:
    return queries.mapInArrow(_counts(None), "doc_id long, dl long, terms array<long>, tfs array<long>").select(F.col("doc_id").alias("query_id"), F.explode("terms").alias("term")).distinct()


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(query_id, tau): the k-th best sum so far of each query, 0 where there are fewer."""
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "doc_id")
    return sums.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("s")).otherwise(0).alias("tau"))


def topk_search(docs: DataFrame, queries: DataFrame, k: int = K, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) of the k documents of highest positive score for every query, ties by the lesser doc_id.

    Words are runs of letters and digits, ASCII letters in lower case; a query's repeated words count once. Null ids
    and null texts are left out on both sides; queries without words, or whose words no document has, have no rows. Rows
    that repeat a query's id are one query of all their words; of rows that repeat a doc_id the one with most words counts.
    Other columns are ignored.
    """
    q = pick(queries, **{query_id: "long", query_text: "string"}).toDF("doc_id", "text").where("doc_id is not null and text is not null")
    qw = materialize(_query_words(q), "query-words")
    d = pick(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    asked = qw.select("term").distinct()
    n_asked = asked.count()
    vocabulary = np.sort(asked.toArrow()["term"].to_numpy().view(np.uint64)) if n_asked <= BROADCAST_WORDS else None
    counted = d.mapInArrow(_counts(vocabulary), "doc_id long, dl long, terms array<long>, tfs array<long>")
    counted = materialize(counted.groupBy("doc_id").agg(F.max(F.struct("dl", "terms", "tfs")).alias("x")).select("doc_id", "x.*"), "counted")
    n, total = counted.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    average = total / n if n else 1.0
    entries = counted.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("doc_id", "dl", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    if vocabulary is None:
        entries = entries.join(asked, "term", "left_semi")
    # one row a query word
    frequency = materialize(entries.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    small = n_asked <= BROADCAST_WORDS
    frequency = F.broadcast(frequency) if small else frequency
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(average))))
    scored = materialize(entries.join(frequency, "term").select("term", "doc_id", F.floor(part * 1e6 + 0.5).alias("s")).where("s > 0"), "scored")

    # phase one
    best = Window.partitionBy("term").orderBy(F.col("s").desc(), "doc_id")
    heads = materialize(scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k), "heads")
    tops = heads.groupBy("term").agg(F.max("s").alias("most"))
    words_of = materialize(qw.join(tops, "term"), "words-of")  # words that no document has can't add anything
    n_lists = words_of.count()
    small = n_lists <= BROADCAST_ROWS

    def hint(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    def exact(pairs: DataFrame) -> DataFrame:
        """(query_id, doc_id, s): whole scores of pairs."""
        wanted = pairs.join(hint(words_of.select("query_id", "term")), "query_id")
        return scored.join(wanted, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"))

    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "doc_id")
    first = words_of.join(heads.select("term", "doc_id", "s"), "term").groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"))
    first = materialize(first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "doc_id"), "first")
    tau = _kth(exact(first), k)
    cut = words_of.join(tau, "query_id").groupBy("query_id", "tau").agg(F.sort_array(F.collect_list("most")).alias("most")).select("query_id", "tau", _cutoff().alias("cut"))  # one entry a word of the query
    lists_of = materialize(words_of.join(cut, "query_id").withColumn("rest", F.least(F.col("cut") - 1, F.col("most"))), "lists")

    # phase two; a list is first cut at the least cutoff of its queries
    lowest = lists_of.groupBy("term").agg(F.min("cut").alias("low"))
    reached = scored.join(hint(lowest), "term").where("s >= low").join(hint(lists_of.select("query_id", "term", "cut", "rest")), "term").where("s >= cut")
    seen = materialize(reached.groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"), F.sum("rest").alias("known")), "seen")
    bound = lists_of.groupBy("query_id").agg(F.sum("rest").alias("all_rest"), F.first("tau").alias("least"))
    limits = bound.join(_kth(seen, k), "query_id").select("query_id", "all_rest", F.greatest("least", "tau").alias("tau"))
    left = seen.join(hint(limits), "query_id").where(F.col("s") + F.col("all_rest") - F.col("known") >= F.col("tau")).select("query_id", "doc_id")
    left = materialize(left, "candidates")

    # phase three
    return exact(left).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", (F.col("s") / 1e6).alias("score"))


def _cutoff() -> Column:
    """Of the ascending `most` of a query's lists and its tau: the largest cutoff c, 1 at least, with sum(least(c - 1, most)) < tau."""
    # the lists before place i give all they have, the others c - 1 each; the first i at which c - 1 is under the next list's best is the one
    n = F.size("most")
    step = F.aggregate("most", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("i"), F.lit(None).cast("long").alias("c")),
        lambda a, x: F.when(a["c"].isNotNull(), a).when(_share(a, n) < x, F.struct(a["sum"].alias("sum"), a["i"].alias("i"), _share(a, n).alias("c"))).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["i"] + 1).alias("i"), a["c"].alias("c"))))
    return F.greatest(F.lit(1).cast("long"), F.coalesce(step["c"], F.lit(0).cast("long")) + 1)


def _share(a: Column, n: Column) -> Column:
    return F.floor((F.col("tau") - 1 - a["sum"]) / (n - a["i"]))


ORACLE_SQL = f"""
with q as (select distinct item_id as query_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+')) as term from benchmark where item_id is not null and text is not null),
w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+') as w from documents where doc_id is not null and text is not null),
l as (select doc_id, len(w) as dl, w from w where len(w) > 0),
g as (select count(*) as n, sum(dl) / count(*) as average from l),
t as (select doc_id, dl, unnest(w) as term from l),
p as (select doc_id, dl, term, count(*) as tf from t where term in (select term from q) group by all),
f as (select term, count(*) as df from p group by term),
s as (select p.term, doc_id, floor(ln(1.0::double + (n::double - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1}::double) / (tf + {K1}::double * ({1 - B}::double + {B}::double * dl / average)) * 1e6::double + 0.5)::bigint as s from p join f using (term), g),
x as (select query_id, doc_id, sum(s) as s from q join s using (term) where s > 0 group by all),
r as (select *, row_number() over (partition by query_id order by s desc, doc_id) as rank from x)
select query_id, rank, doc_id, s / 1e6::double as score from r where rank <= {K}
"""


def query(spark, sf_dir: str) -> DataFrame:
    return topk_search(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
