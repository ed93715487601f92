"""Operator 3: mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled (ordered by a seeded digest of their ids) and laid end to end; the stream of
tokens is cut into blocks of BLOCK tokens, of which only a source's last may be shorter. Slot i of the schedule is the
point (i * G) mod 2^31 of a golden-ratio sequence, mapped through the cumulative weights to a source; the k-th slot of a
source takes its k-th block. A source that runs out leaves: slots that fall on it are dropped, which leaves the others'
proportions as they were. The schedule ends when it has placed about SHARE of all blocks of the sources that have a weight, so no block is used twice, every
prefix of it holds the sources that are not used up in the target proportions, to within a few blocks, and a small source cannot end it.

All running sums are taken in two steps, within buckets of the shuffled order and over the buckets, so that no task
holds a whole source, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

BLOCK = 1024
#: Without given weights a source's weight is its share of the tokens to this power, which favours small sources.
TEMPERATURE = 0.7
#: Part of the blocks that the schedule places.
SHARE = 0.9
SEED = "mix-1"
_M = 1 << 31
_G = 1327217885  # odd, nearest to 2^31 / golden ratio
_RUN = 4096  # slots by bucket
_BINS = 1 << 16  # equal parts of [0, 2^31) by which slots find their source
#: Sources up to which their cuts are broadcast.
BROADCAST_SOURCES = 100_000


def _key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id, F.lit(-1)).cast("string")))


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def _located(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, n, start): each document's place in its source's shuffled stream."""
    d = pick(docs, doc_id="long", source="string", text="string").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), _key(F.col("doc_id")).alias("key"), _tokens(F.col("text")).alias("n"))
    d = materialize(d.where("n > 0").withColumn("bucket", F.substring("key", 1, 3)), "mix")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most 4096 buckets a source
    buckets = d.groupBy("source", "bucket").agg(F.sum("n").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).select("source", "bucket", "base")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(buckets, ["source", "bucket"])
    return d.select("doc_id", "source", "key", "n", (F.col("in") + F.col("base")).alias("start"))


def _targets(located: DataFrame, weights: dict[str, float] | None, temperature: float, block: int) -> DataFrame:
    """(source, blocks, lo, hi): each source's stretch of [0, 2^31), in order of name; every source with a weight has one of 1 at least. One row a source, in one task's window."""
    totals = located.groupBy("source").agg(F.sum("n").alias("t"))
    if weights is None:
        w = totals.withColumn("w", F.pow(F.col("t").cast("double"), F.lit(temperature)))
    else:
        given = located.sparkSession.createDataFrame([(s, float(x)) for s, x in weights.items()], "source string, w double")
        w = totals.join(given, "source").where("w > 0")
    upto = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    everywhere = Window.partitionBy(F.lit(0))
    # sums in order of name
    w = w.withColumn("run", F.sum("w").over(upto)).withColumns({"whole": F.max("run").over(everywhere), "sources": F.count("*").over(everywhere)})
    w = w.withColumn("width", 1 + F.floor(F.col("w") / F.col("whole") * (F.lit(_M - 1) - F.col("sources")).cast("double")).cast("long"))
    hi = F.sum("width").over(upto)
    return materialize(w.select("source", F.expr(f"(t + {block - 1}) div {block}").alias("blocks"), (hi - F.col("width")).alias("lo"), hi.alias("hi")), "targets")


def _slot_count(targets: DataFrame, share: float) -> int:
    """The slots after which `share` of the blocks are placed, if every source had its exact part of them, and two a source for what the sequence strays from that."""
    per = (F.lit(float(_M)) / (F.col("hi") - F.col("lo")).cast("double"))
    upto = Window.orderBy("end", "source").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0))
    e = targets.withColumn("end", F.col("blocks").cast("double") * per)
    e = e.withColumns({"before": F.coalesce(F.sum("blocks").over(upto), F.lit(0)), "gone": F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(upto), F.lit(0)), "all": F.sum("blocks").over(everywhere), "wide": F.sum(F.col("hi") - F.col("lo")).over(everywhere)})
    slots = F.ceil((F.ceil(F.col("all").cast("double") * share) - F.col("before")).cast("double") * (F.lit(float(_M)) / (F.col("wide") - F.col("gone")).cast("double"))).cast("long")
    # the first source, in the order of running out, that would last until then
    row = e.withColumn("slots", slots).where(F.col("slots") <= F.ceil("end")).agg(F.min(F.struct("end", "source", "slots")).alias("x")).first()
    return row["x"]["slots"] + 2 * targets.count() if row["x"] else 0


def _schedule(targets: DataFrame, share: float) -> DataFrame:
    """(slot, source, block): the block is the slot's rank among its source's; slots of no block are left out."""
    spark = targets.sparkSession
    n = _slot_count(targets, share)
    width = _M // _BINS
    slots = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % _M) * _G % _M).alias("point"), F.expr(f"id div {_RUN}").alias("run")).withColumn("bin", F.expr(f"point div {width}"))
    bins = targets.select("source", "blocks", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("bin"))
    # at most one row a source and bin
    bins = F.broadcast(bins) if targets.count() <= BROADCAST_SOURCES else bins
    slots = slots.join(bins, "bin").where("point >= lo and point < hi").select("slot", "source", "blocks", "run")
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = slots.groupBy("source", "run").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).select("source", "run", "base")
    rank = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    out = slots.withColumn("in", rank).join(runs, ["source", "run"]).select("slot", "source", "blocks", (F.col("in") + F.col("base")).cast("long").alias("block"))
    return out.where("block < blocks").select("slot", "source", "block")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """(slot, source, block, doc_id, from_token, to_token): the stretches of documents, in their own tokens, of every scheduled block.

    Tokens are runs of non-blank characters. A null source counts as the source ''; null and blank texts have no tokens
    and take part in nothing; a null id is shuffled as -1 and repeated rows are further documents. Sources absent from
    given weights, or of weight 0, are not scheduled; any other has at least one of 2^31 points. An empty table gives no rows; other columns are ignored.
    """
    located = materialize(_located(docs), "located")
    plan = _schedule(_targets(located, weights, temperature, block), share)
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}")
    pieces = located.select("doc_id", "source", "n", "start", F.explode(F.sequence(first, last)).alias("block"))
    cut = pieces.select("source", "block", "doc_id", F.greatest(F.lit(0), F.col("block") * block - F.col("start")).cast("long").alias("from_token"), F.least(F.col("n"), (F.col("block") + 1) * block - F.col("start")).cast("long").alias("to_token"))
    return plan.join(cut, ["source", "block"]).select("slot", "source", "block", "doc_id", "from_token", "to_token")


def keep_mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """The rows of docs, with all their columns, whose first token lies in a scheduled block; rows without tokens go with their place in the order.

    Nulls, repeated rows and empty tables are as in mix_sources(). Each source's cut is one key in its shuffled order, and rows are kept by comparing with it;
    up to BROADCAST_SOURCES cuts are broadcast, so texts are not shuffled.
    """
    located = materialize(_located(docs), "located")
    targets = _targets(located, weights, temperature, block)
    used = _schedule(targets, share).groupBy("source").agg((F.count("*") * block).alias("stop"))
    # the first document of each source beyond its scheduled tokens; sources without a target have none scheduled
    cuts = located.join(used, "source", "left").where("stop is null or start >= stop").groupBy("source").agg(F.min(F.struct("key", F.coalesce("doc_id", F.lit(-1)).alias("id"))).alias("cut"))
    cut = materialize(cuts.select(F.col("source").alias("_s"), F.col("cut.key").alias("_k"), F.col("cut.id").alias("_i")), "cuts")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut
    place = {c: k for k, c in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    doc, src = F.col(f"_{place['doc_id']}").cast("long"), F.coalesce(F.col(f"_{place['source']}").cast("string"), F.lit(""))
    own = plain.withColumns({"_src": src, "_key": _key(doc), "_id": F.coalesce(doc, F.lit(-1))})
    kept = own.join(cut, F.col("_src") == F.col("_s"), "left").where("_k is null or _key < _k or (_key = _k and _id < _i)")
    return kept.select(*[f"_{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


ORACLE_SQL = f"""
with d as (select doc_id, coalesce(source, '') as source, md5('{SEED}:' || coalesce(doc_id, -1)) as key, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) as n from documents),
l as (select *, sum(n) over (partition by source order by key, doc_id rows unbounded preceding) - n as start from d where n > 0),
t as (select source, sum(n) as t, pow(sum(n)::double, {TEMPERATURE}) as w from l group by source),
c as (select source, t, w, count(*) over () as sources, sum(w) over (order by source rows unbounded preceding) as run from t),
d2 as (select *, max(run) over () as whole from c),
e as (select source, (t + {BLOCK - 1}) // {BLOCK} as blocks, 1 + floor(w / whole * ({_M - 1} - sources)::double)::bigint as width from d2),
g as (select source, blocks, width, sum(width) over (order by source rows unbounded preceding) as hi from e),
o as (select *, blocks::double * ({_M}::double / width::double) as last from g),
p as (select *, sum(blocks) over () as whole, sum(width) over () as wide, coalesce(sum(blocks) over (order by last, source rows between unbounded preceding and 1 preceding), 0) as before,
  coalesce(sum(width) over (order by last, source rows between unbounded preceding and 1 preceding), 0) as gone from o),
u as (select last, source, ceil((ceil(whole::double * {SHARE}::double) - before)::double * ({_M}::double / (wide - gone)::double))::bigint as slots from p),
m as (select coalesce(first(slots order by last, source) + 2 * (select count(*) from g), 0) as n from u where slots <= ceil(last)),
s as (select i as slot, (i % {_M}) * {_G} % {_M} as p from m, range(0, m.n) r(i)),
q as (select * from (select slot, source, blocks, row_number() over (partition by source order by slot) - 1 as block from s join g on p >= hi - width and p < hi) where block < blocks),
b as (select source, doc_id, n, start, unnest(range((start // {BLOCK})::bigint, ((start + n - 1) // {BLOCK})::bigint + 1)) as block from l)
select slot, q.source, q.block, doc_id, greatest(0, q.block * {BLOCK} - start)::bigint as from_token, least(n, (q.block + 1) * {BLOCK} - start)::bigint as to_token
from q join b on q.source = b.source and q.block = b.block
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
