"""Operator 4: document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text: H(i) = 2 H(i - 1) + G[byte i] modulo 2^64, where only G's upper 16 bits are
set, so it depends on the last 16 bytes alone. A chunk ends where the hash's leading bits are zero: more bits are asked for before the normal size than after
it, which draws chunk sizes together. Boundaries move with the content, so an insertion changes the chunks that it
touches and no others. A document's fingerprint is the set of its chunks' digests, each weighing its length in bytes;
containment of one document in another is the weight of the digests that both have over the weight of its own.

The report links all documents of which one is contained in the other by at least THRESHOLD. Documents of equal
fingerprints are one text. A text that is contained that much shares one of its rarest chunks with its container: leaving out
its most frequent ones up to less than THRESHOLD of its weight leaves nothing to lose. Texts are partitioned into groups of at most GROUP by the least digest of those chunks;
a text opens the groups of all that hold one of them, and is compared with their members on the whole sets.
No task holds more than GROUP sets, and rows out are a few for each text, however many share a chunk. Comparing a cluster of m different texts still takes m^2 comparisons.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, pick
from .textops import buffers, lists, mix64, slices

#: Bytes. Chunks other than a text's last are of LEAST to MOST bytes: a passage of 50 words holds several.
LEAST, NORMAL, MOST = 16, 48, 128
#: Containment from which documents are linked.
THRESHOLD = 0.5
#: Members of a group; a larger one is divided by hash of the id.
GROUP = 4096
#: Rows of repeated texts up to which their numbers are broadcast (8 bytes each).
BROADCAST_ROWS = 2_000_000
#: Leading zero bits asked for before and after the normal size.
STRICT, LOOSE = 6, 4

#: Only the upper 16 bits are set, so a byte is shifted out after 16 more and cuts fall in step soon after a passage begins.
GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48) << np.uint64(48)


def gear(t: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, from 16 bytes on; by doubling the stretch that is summed."""
    x = GEAR[t]
    for s in (1, 2, 4, 8):
        if len(x) > s:
            x[s:] = x[s:] + (x[:-s] << np.uint64(s))
    return x


def boundaries(size: int, strict: list[int], loose: list[int]) -> list[int]:
    """Ends of a text's chunks; strict and loose are the positions after bytes that satisfy either mask, ascending."""
    out, s = [], 0
    while size - s > LEAST:
        k = bisect_left(strict, s + LEAST)
        if k < len(strict) and strict[k] < s + NORMAL and strict[k] <= size:
            e = strict[k]
        else:
            k = bisect_left(loose, s + NORMAL)
            e = loose[k] if k < len(loose) and loose[k] <= s + MOST else s + MOST
        if e >= size:
            break
        out.append(e)
        s = e
    return [*out, size] if size else out


#: A chunk is one integer: 57 bits of its digest, then its length less one, as MOST is at most 128.
_BITS = 7
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chunks", pa.int32()), ("chunks", pa.list_(pa.int64()))])
_DDL = "doc_id long, n_bytes long, n_chunks int, chunks array<long>"


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top = np.uint64(64)
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        b, offs = buffers(batch.column(1))
        for i, j in slices(offs):
            base = int(offs[i])
            raw = b[base : int(offs[j])].tobytes()
            # the first 15 bytes of a text, whose hash has bytes of another text in it, are never looked at: LEAST is 16
            h = gear(b[base : int(offs[j])])
            loose = np.flatnonzero(h >> (top - np.uint64(LOOSE)) == 0)
            strict = loose[h[loose] >> (top - np.uint64(STRICT)) == 0]
            edge = offs[i : j + 1] - base
            lo, st = np.searchsorted(loose, edge), np.searchsorted(strict, edge)
            loose, strict = (loose + 1).tolist(), (strict + 1).tolist()
            count, chunks, at = [], [], [0]
            for r in range(j - i):
                first, size = int(edge[r]), int(edge[r + 1] - edge[r])
                ends = boundaries(size, [x - first for x in strict[st[r] : st[r + 1]]], [x - first for x in loose[lo[r] : lo[r + 1]]])
                seen, s = {}, 0
                for e in ends:
                    seen[digest(raw[first + s : first + e]) >> _BITS << _BITS | (e - s - 1)] = None
                    s = e
                count.append(len(ends))
                chunks += seen
                at.append(len(chunks))
            c = lists(np.array(chunks, np.uint64).view(np.int64), np.array(at), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(edge)), pa.array(count, pa.int32()), c], schema=_SKETCH)


def _prints(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").mapInArrow(_chunker, _DDL)


def _length(chunk: F.Column) -> F.Column:
    return (chunk.bitwiseAND(F.lit(MOST - 1)) + 1).cast("int")


def _arrays() -> list[F.Column]:
    return [F.transform("chunks", lambda c: F.shiftrightunsigned(c, _BITS)).alias("digests"), F.transform("chunks", _length).alias("lengths")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, digests, lengths) of every row: the distinct chunks in order of appearance.

    A null or empty text has no chunks. Null ids stay null, repeated rows give repeated results, other columns are ignored.
    """
    return _prints(docs).select("doc_id", "n_bytes", "n_chunks", *_arrays())


def _exploded(prints: DataFrame) -> DataFrame:
    return prints.select("doc_id", F.explode(F.arrays_zip("digests", "lengths")).alias("c")).select("doc_id", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("length")).distinct()


def containment(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, shared, containment): of document a in document b, for given pairs of ids. Documents without chunks have 0."""
    c = _exploded(prints)
    weight = c.groupBy("doc_id").agg(F.sum("length").alias("weight"))
    ids = pairs.select(F.col("doc_a").cast("long"), F.col("doc_b").cast("long")).distinct()
    both = ids.join(c.withColumnRenamed("doc_id", "doc_a"), "doc_a").join(c.select(F.col("doc_id").alias("doc_b"), "digest"), ["doc_b", "digest"]).groupBy("doc_a", "doc_b").agg(F.sum("length").alias("shared"))
    out = ids.join(both, ["doc_a", "doc_b"], "left").join(weight.withColumnRenamed("doc_id", "doc_a"), "doc_a", "left")
    return out.select("doc_a", "doc_b", F.coalesce("shared", F.lit(0)).alias("shared"), F.round(F.coalesce(F.col("shared") / F.col("weight"), F.lit(0.0)), 6).alias("containment"))


class _Forest:
    """Which edges connect what was not connected yet."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def joins(self, x: int, y: int) -> bool:
        root = self.root
        for z in (x, y):
            root.setdefault(z, z)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
        return x != y


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("part", pa.float64())])
_LINKS_DDL = "a long, b long, links long, part double"


def _flat(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    c = batch.column(k)
    o = c.offsets.to_numpy().astype(np.int64)
    return c.values.to_numpy()[o[0] : o[-1]], o - o[0]


def _opener(threshold: float):
    """Compares, within each (grp, part), queries with the group's members.

    Rows come sorted by group and part, members first. A pair is looked at from its lighter text (of equal weights the lesser id).
    Rows out: edges that connect what is linked (links null), and by text its links and the text that contains most of it (b, part).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group, forest, out = None, [], None, None, []
        links = best = by = None

        def begin() -> None:
            nonlocal group, forest, links, best, by
            ids, copies, weight, chunks = zip(*held) if held else ((), (), (), ())
            flat = np.concatenate(chunks) if held else np.zeros(0, np.int64)
            who = np.repeat(np.arange(len(ids)), [len(x) for x in chunks])
            o = np.argsort(flat, kind="stable")
            group = np.array(ids, np.int64), np.array(copies, np.int64), np.array(weight, np.int64), flat[o], who[o]
            forest = _Forest()
            links, best, by = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64)

        def compare(doc: int, copies: int, weight: int, chunks: np.ndarray) -> None:
            ids, n, w, flat, who = group
            lo, hi = np.searchsorted(flat, chunks, "left"), np.searchsorted(flat, chunks, "right")
            c = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            common = np.bincount(who[at], np.repeat((chunks & (MOST - 1)) + 1, c), len(ids))
            k = np.flatnonzero((common >= threshold * weight) & ((w > weight) | ((w == weight) & (ids > doc))))
            if not len(k):
                return
            mine, theirs = common[k] / weight, common[k] / w[k]
            m = int(np.lexsort((ids[k], -mine))[0])
            out.append((doc, int(ids[k][m]), int(n[k].sum()), float(mine[m])))
            links[k] += copies
            better = (theirs > best[k]) | ((theirs == best[k]) & (doc < by[k]))
            best[k[better]], by[k[better]] = theirs[better], doc
            out.extend((doc, x, None, None) for x in ids[k].tolist() if forest.joins(doc, x))

        def end() -> None:
            if group is not None:
                k = np.flatnonzero(links)
                out.extend(zip(group[0][k].tolist(), by[k].tolist(), links[k].tolist(), best[k].tolist()))

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out), _LINKS)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=_LINKS)

        for batch in batches:
            grp, part, doc, copies, member, weight = (batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(6))
            chunks, at = _flat(batch, 6)
            for r in range(batch.num_rows):
                if (grp[r], part[r]) != key:
                    end()
                    key, held, group = (grp[r], part[r]), [], None
                x = slice(at[r], at[r + 1])
                if member[r]:
                    held.append((doc[r], copies[r], weight[r], chunks[x].copy()))
                    continue
                if group is None:
                    begin()
                compare(doc[r], copies[r], weight[r], chunks[x])
                if len(out) > 100_000:
                    yield flush()
        end()
        if out:
            yield flush()

    return run


def _weight(chunks: str) -> F.Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda a, x: a + _length(x))


def _linked(texts: DataFrame, facts: DataFrame, threshold: float, group: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, links, part) as _opener() gives it, and (rep, again): the weight of chunks that other texts have too. texts: rep, chunks; facts: rep, copies, weight."""
    c = texts.select("rep", F.explode("chunks").alias("chunk"))
    df = c.groupBy("chunk").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    shared = c.join(df, "chunk")
    # a text's shared chunks, the most frequent first
    listed = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "chunk")), asc=False).alias("t")).select("rep", F.transform("t", lambda x: x["chunk"]).alias("chunks"))
    listed = materialize(listed.join(facts, "rep"), "shared")
    # they are left out from the look-up while they weigh less than the threshold
    limit = F.col("weight") * threshold
    state = F.struct(F.lit(0.0).alias("left"), F.lit(0).alias("n"))
    left = F.aggregate("chunks", state, lambda s, x: F.when(s["left"] + _length(x) < limit, F.struct((s["left"] + _length(x)).cast("double").alias("left"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(float("inf")).alias("left"), s["n"].alias("n"))))
    ranked = listed.withColumn("look", F.slice("chunks", left["n"] + 1, F.greatest(F.size("chunks"), F.lit(1))))
    own = ranked.select("rep", F.coalesce(F.array_min("look"), F.array_min("chunks")).alias("grp"))
    # any division into groups is right, so a hot one is divided further
    hot = own.groupBy("grp").agg(F.count("*").alias("c")).where(F.col("c") > group)
    own = own.join(hot, "grp", "left").select("rep", F.when(F.col("c").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", F.expr(f"pmod(xxhash64(rep), cast(ceil(c / {group}) as bigint))"))).alias("grp"))
    own = materialize(own, "groups")
    look = ranked.select("rep", F.explode("look").alias("chunk"))
    index = listed.join(own, "rep").select(F.explode("chunks").alias("chunk"), "grp").distinct()
    opened = materialize(look.join(index, "chunk").select("rep", "grp").distinct(), "opened")
    # a group that many texts open is compared in parts, each with all its members
    parts = opened.groupBy("grp").agg(F.ceil(F.count("*") / (4 * group)).cast("int").alias("parts"))
    members = own.join(parts, "grp").select("rep", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member"))
    queries = opened.join(parts, "grp").select("rep", "grp", F.expr("cast(pmod(xxhash64(rep, 7), parts) as int)").alias("part"), F.lit(False).alias("member"))
    # groups of one text that only itself opens need no look
    alone = opened.join(own.select("grp", F.col("rep").alias("owner")), "grp").groupBy("grp").agg(F.max(F.col("rep") != F.col("owner")).alias("met")).where("met").select("grp")
    roles = members.unionByName(queries).join(alone, "grp", "left_semi")
    # chunks of one text alone can't be common to two
    sets = listed.join(roles, "rep").select("grp", "part", "rep", "copies", "member", "weight", "chunks").repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("member").desc(), "rep")
    return sets.mapInArrow(_opener(threshold), _LINKS_DDL), listed.select("rep", _weight("chunks").alias("again"))


def fingerprint_report(docs: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, digests, lengths, weight, copy_of, repeated, class_id, links, partner, containment), one row for each doc_id.

    weight is the length of the distinct chunks. copy_of is the least id with the same set of chunks, the document's own if there is none
    before it. repeated is the share of the weight in chunks that documents of other fingerprints have too. links is the number of other documents,
    copies included, of which this one contains the threshold or that contain as much of it; classes are what links
    connect, named by their least id. partner is, of documents of other fingerprints that are linked, the one that contains most of this one (of equals the
    least; copies by their least id), and containment how much of it; null without links to others. A null or empty text has no chunks, is
    repeated by 0 and a class of its own. Null ids are left out; of rows that repeat an id with different texts the one
    with most bytes, then of the greatest digests, counts. Costs grow with the number of chunks, except within clusters of different texts.
    """
    sets = F.sort_array("chunks")
    whole = _prints(docs).where("doc_id is not null").select(F.monotonically_increasing_id().alias("row"), "*", F.xxhash64(sets).alias("h"), F.hash(sets).alias("i"), _weight("chunks").alias("weight"))
    prints = materialize(whole, "prints")
    light = prints.select("row", "doc_id", "n_bytes", "n_chunks", "h", "i", "weight")
    one = light.groupBy("doc_id").agg(F.max_by(F.struct("row", "h", "i", "n_chunks", "weight"), F.struct("n_bytes", "h", "i", -F.col("row"))).alias("x")).select("doc_id", "x.*")
    # texts without chunks are no copies of one another
    key = F.when(F.col("n_chunks") == 0, F.col("doc_id")).otherwise(F.lit(0)).alias("alone")
    one = one.withColumn("alone", key)
    least = one.groupBy("h", "i", "alone").agg(F.min_by(F.struct("doc_id", "row"), "doc_id").alias("x"), F.count("*").alias("copies")).select("h", "i", "alone", F.col("x.doc_id").alias("rep"), F.col("x.row").alias("rep_row"), "copies")
    of = materialize(one.join(least, ["h", "i", "alone"]).select("doc_id", "row", "rep", "rep_row", "copies", "n_chunks", "weight"), "copies")
    # rows that are not their text's first; they are few enough for a broadcast, or joined
    n_rows, n_texts = light.count(), of.where("row = rep_row").count()
    other = light.select("row").join(of.where("row = rep_row").select("row"), "row", "left_anti")
    drop = materialize(other, "other-rows")
    drop = F.broadcast(drop) if n_rows - n_texts <= BROADCAST_ROWS else drop
    reps = of.where("row = rep_row")
    texts = prints.where("n_chunks > 0").join(drop, "row", "left_anti").select(F.col("doc_id").alias("rep"), "chunks")
    got, again = _linked(texts, reps.select("rep", "copies", "weight"), threshold, group)
    got = materialize(got, "links")
    near = got.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("near"), F.max(F.struct("part", (-F.col("b")).alias("b"))).alias("p"))
    root = components(got.where("links is null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    facts = of.join(near, "rep", "left").join(root, "rep", "left").join(again, "rep", "left")
    facts = facts.select("row", F.col("rep").alias("copy_of"), F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "again", (-F.col("p.b")).alias("partner"), F.round("p.part", 6).alias("containment"))
    out = prints.join(facts, "row")
    return out.select("doc_id", "n_bytes", "n_chunks", *_arrays(), "weight", "copy_of", F.round(F.coalesce(F.col("again") / F.col("weight"), F.lit(0.0)), 6).alias("repeated"), "class_id", "links", "partner", "containment")


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
