"""Operator 2: documents whose word n-gram sets have a Jaccard similarity of at least a threshold, as classes and numbers of links.

Method: a token-group matrix. Documents of equal n-gram sets collapse to one representative. Representatives are
partitioned into groups by the least hash of their n-grams (a min-hash, so similar documents tend to share a group) and
by size. N-grams have one order for all documents: by hash, but those that are frequent in a sample of the
documents come last (which these are changes the work, not the result). Of a document of k n-grams all but the last
ceil(threshold * k) - 1 are its tokens. Two documents that reach the threshold have a token in common, so every
document is looked up by all its tokens in the groups' unions of tokens. How many hits a group must have follows from
the sizes: what two documents have in common is a token of both, or else not a token of the one whose tokens end first.
Groups that reach this bound are opened. Their members are first screened by bitmaps: a document's has, for each remainder
of its n-grams' hashes, whether their number is odd, in 2 to 4 bits an n-gram. What is in one of two documents only is at least as much as the bits
that differ, which bounds what they have in common from above; so only texts that may reach the threshold with
another one are sent, and those are compared on the whole n-gram sets. So no pair is lost, and reported similarities are exact.

Groups of more than GROUP documents are divided. Groups that open each other are put into one cell, so that a text is sent
to a cell once, however many of its groups are compared with it; cells of more than about GROUP documents are divided, and those that many
queries open are compared in parts, so no task holds more than about twice GROUP n-gram sets. Comparing a cluster of m different texts still takes m^2 comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, pick, release, scratch
from .textops import buffers, gram_sets, lists, slices, words

N = 3
THRESHOLD = 0.6
#: Documents that tell which n-grams are frequent: COMMON_DOCS of them, at most about twice as many, but one in COMMON_SHARE at least, as in a fixed
#: number of documents the least frequency that shows grows with the input. Those that COMMON_DF of the sample have, at most COMMON.
COMMON_DOCS, COMMON_SHARE, COMMON_DF, COMMON = 20000, 4, 4, 1 << 22
#: Representatives up to which they are broadcast (16 bytes each); more are joined by shuffles.
BROADCAST_ROWS = 2_000_000
#: Sizes within a group differ by this factor at most.
SIZES = 1.25
#: Members of a group; a larger one is divided by hash of the id.
GROUP = 2048

#: Words of 64 bits of the smallest bitmap.
LEAST_WORDS = 2

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("grp", pa.int64()), ("bits", pa.binary())])


def _bitmaps(v: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each document with n-grams, the parities of the numbers of its n-grams by remainder. A bitmap has a power of two of bits, at least 2 for each n-gram."""
    has = size[size > 0]
    wide = np.maximum(LEAST_WORDS * 64, 1 << np.ceil(np.log2(2 * has)).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(wide)])
    odd = np.bincount(np.repeat(at[:-1], has) + (v & (np.repeat(wide, has) - 1)), minlength=at[-1]) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(data)])


def _sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            b, offs = buffers(batch.column(1))
            for i, j in slices(offs):
                h, _, _, first = words(b, offs[i : j + 1])
                v, at = gram_sets(h, first, n)
                size = np.diff(at)
                has = np.flatnonzero(size)
                if not len(has):
                    continue
                u = v.astype(np.uint64)
                total = np.zeros(len(u) + 1, np.uint64)
                np.cumsum(u * np.uint64(0x9E3779B97F4A7C15) ^ (u << np.uint64(13)), out=total[1:])
                other = np.zeros(len(u) + 1, np.uint64)
                w = (u ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xC2B2AE3D27D4EB4F)
                np.cumsum(w ^ (w >> np.uint64(29)), out=other[1:])
                d1 = (total[at[1:]] - total[at[:-1]])[has].view(np.int64)
                d2 = (other[at[1:]] - other[at[:-1]])[has].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][has], pa.int64()), pa.array(size[has], pa.int32()), pa.array(d1), pa.array(d2), pa.array(v[at[:-1][has]]), _bitmaps(v, size)], schema=_SKETCH)

    return run


def _grams(n: int, common=None, threshold: float = 0.0):
    """(doc_id, tokens): a document's n-grams; given the frequent n-grams and their places in the order, only its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            b, offs = buffers(batch.column(1))
            for i, j in slices(offs):
                h, _, _, first = words(b, offs[i : j + 1])
                v, at = gram_sets(h, first, n)
                if common is not None:
                    often, place = common.value
                    size, order = np.diff(at), v.astype(np.int64)
                    if len(often):
                        k = np.minimum(np.searchsorted(often, order), len(often) - 1)
                        order = np.where(often[k] == order, place[k] + (1 << 48), order)
                    doc = np.repeat(np.arange(len(size)), size)
                    v = v[np.lexsort((order, doc))]
                    keep = np.arange(len(v)) - at[doc] <= (size - np.ceil(threshold * size - 1e-9))[doc]
                    v, at = v[keep], np.concatenate([[0], np.cumsum(keep)])[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), lists(v, at, pa.int64())], names=["doc_id", "tokens"])

    return run


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent n-grams of a sample of documents, ascending, and each one's place by frequency. At most COMMON of them come to the driver, the most frequent ones."""
    every = min(COMMON_SHARE, max(1, docs.count() // COMMON_DOCS))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0).mapInArrow(_grams(n), "doc_id long, tokens array<long>")
    df = materialize(some.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= COMMON_DF), "common")
    # a least frequency that leaves COMMON of them, so that nothing is sorted on the way to the driver
    least, held = COMMON_DF, 0
    for row in df.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.col("df").desc()).toLocalIterator():
        held += row.n
        if held > COMMON:
            least = row.df + 1
            break
    got = df.where(F.col("df") >= least).toArrow()
    release(docs.sparkSession, df)
    token, df = got["token"].to_numpy(), got["df"].to_numpy()
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, df))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], place[order]


class _Members:
    """A group's members: their n-gram sets as one sorted array of (n-gram, member)."""

    def __init__(self, ids: list[int], copies: list[int], sets: list[np.ndarray]):
        self.ids, self.copies, self.sets = np.array(ids, np.int64), np.array(copies, np.int64), sets
        self.size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(sets)), self.size)
        o = np.argsort(flat, kind="stable")
        self.flat, self.who = flat[o], who[o]

    def overlaps(self, x: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.who[at], minlength=len(self.ids))

    def similar(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Members that reach the threshold, and their similarities."""
        common = self.overlaps(x)
        j = common / (len(x) + self.size - common)
        k = np.flatnonzero(j >= threshold)
        return k, j[k]


class _Screen:
    """A cell's members by their bitmaps, which tell of most pairs that they don't reach the threshold."""

    def __init__(self, ids: list[int], n: list[int], grps: list[int], bits: list[bytes], threshold: float):
        self.ids, self.n, self.threshold = np.array(ids, np.int64), np.array(n, np.int64), threshold
        own = [np.frombuffer(x, np.uint64) for x in bits]
        self.words = np.array([len(x) for x in own], np.int64)
        names, which = np.unique(np.array(grps, np.int64), return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.of = dict(zip(names.tolist(), np.split(order, np.cumsum(np.bincount(which))[:-1])))
        # bitmaps of different sizes are compared at the smaller one; sizes that may reach the threshold are so many halves apart at most
        self.halves = int(np.ceil(-np.log2(threshold)))
        folded: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, x in enumerate(own):
            for half in range(self.halves + 1):
                if (w := len(x) >> half) >= LEAST_WORDS:
                    folded.setdefault(w, []).append((k, np.bitwise_xor.reduce(x.reshape(-1, w), axis=0)))
        self.at = {}
        for w, rows in folded.items():
            row = np.full(len(own), -1)
            row[[k for k, _ in rows]] = np.arange(len(rows))
            self.at[w] = row, np.array([x for _, x in rows])

    def may(self, doc: int, n: int, bits: bytes, groups: list[int]) -> np.ndarray:
        """Members of the groups, other than the document itself, that may reach the threshold with it."""
        k = np.concatenate([np.zeros(0, np.int64), *(self.of[g] for g in groups if g in self.of)])
        t = self.threshold
        k = k[(self.ids[k] != doc) & (self.n[k] >= t * n - 1e-6) & (t * self.n[k] <= n + 1e-6)]
        x, found = np.frombuffer(bits, np.uint64), []
        for half in range(self.halves + 1):
            w = len(x)
            at = k[self.words[k] == w] if half else k[self.words[k] >= w]
            if len(at):
                row, rows = self.at[w]
                apart = np.bitwise_count(rows[row[at]] ^ x).sum(axis=1, dtype=np.int64)
                both = n + self.n[at]
                found.append(at[(both - apart) / 2 >= t / (1 + t) * both - 1e-6])
            if w == LEAST_WORDS:
                break
            x = x[: w // 2] ^ x[w // 2 :]
        return np.concatenate(found) if found else k[:0]


def _screener(threshold: float):
    """(cell, part, doc_id) of the documents that may reach the threshold with another one of (cell, part), of those that _opener() compares there. Rows come sorted as it takes them, with bitmaps for texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, screen, near = None, ([], [], [], [], []), None, None
        out: list[tuple] = []

        def begin() -> None:
            nonlocal screen, near
            screen, near = _Screen(*held[:4], threshold), np.zeros(len(held[0]), bool)
            for i, (doc, n, grp, bits, opens) in enumerate(zip(*held)):
                if opens is not None and len(k := screen.may(doc, n, bits, [grp, *opens])):
                    near[k] = near[i] = True

        def end() -> None:
            nonlocal screen
            if key is not None and screen is None:
                begin()
            if screen is not None:
                out.extend((*key, doc) for doc in screen.ids[near].tolist())
            screen = None

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["cell", "part", "doc_id"])

        for batch in batches:
            for cell, part, doc, n, member, grp, opens, bits in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if (cell, part) != key:
                    end()
                    key, held = (cell, part), ([], [], [], [], [])
                if member:
                    # a repeated row of an id counts once
                    if not held[0] or held[0][-1] != doc:
                        for into, y in zip(held, (doc, n, grp, bits, opens)):
                            into.append(y)
                else:
                    if screen is None:
                        begin()
                        last = None
                    if doc != last:
                        last = doc
                        if len(k := screen.may(doc, n, bits, opens)):
                            near[k] = True
                            out.append((cell, part, doc))
            if len(out) > 100_000:
                yield flush()
        end()
        if out:
            yield flush()

    return run


class _Forest:
    """Which edges connect what was not connected yet."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def joins(self, x: int, y: int) -> bool:
        rx, ry = self.find(x), self.find(y)
        if rx != ry:
            self.root[max(rx, ry)] = min(rx, ry)
        return rx != ry


_LINKS = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("value", pa.float64())])


def _opener(n: int, threshold: float, classes: bool):
    """Compares, within each (cell, part), documents with the members of the groups that they open, and members with others of their own group.

    Rows come sorted by cell and part, members first; queries pass by one at a time. A row has the document's own group and those
    it opens here; a member that is held for others only has null for these. Rows out are the pairs with their
    similarity; or, for classes, edges that connect what the pairs connect (value null), and numbers of links by document (doc_b null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group, forest, grps = None, ([], [], [], [], []), None, None, None
        links: np.ndarray | None = None
        out: list[tuple] = []

        def compare(doc: int, copies: int, x: np.ndarray, opens: list[int], among: int | None = None) -> None:
            k, j = group.similar(x, threshold)
            if not len(k):
                return
            meet = np.isin(grps[k], np.array(opens, np.int64)) & (group.ids[k] != doc)
            if among is not None:
                meet |= (grps[k] == grps[among]) & (k > among)
            k, j = k[meet], j[meet]
            if not len(k):
                return
            if not classes:
                out.extend((min(doc, m), max(doc, m), v) for m, v in zip(group.ids[k].tolist(), j.tolist()))
                return
            links[k] += copies
            total = int(group.copies[k].sum())
            if among is None:
                out.append((doc, None, float(total)))
            else:
                links[among] += total
            out.extend((doc, m, None) for m in group.ids[k].tolist() if forest.joins(doc, m))

        def begin() -> None:
            """All members are here: they meet each other."""
            nonlocal group, links, forest, grps
            group, links, forest = _Members(*held[:3]), np.zeros(len(held[0]), np.int64), _Forest()
            grps = np.array(held[3], np.int64)
            for i, opens in enumerate(held[4]):
                if opens is not None:
                    compare(int(group.ids[i]), int(group.copies[i]), group.sets[i], opens, i)

        def end() -> None:
            nonlocal group
            if key is not None and group is None:
                begin()
            if group is not None and classes:
                out.extend((int(group.ids[i]), None, float(links[i])) for i in np.flatnonzero(links).tolist())
            group = None

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out), _LINKS)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=_LINKS)

        for batch in batches:
            cell, part, doc, copies, member, own, opens = (batch.column(k).to_pylist() for k in range(7))
            b, offs = buffers(batch.column(7))
            for i, j in slices(offs):
                h, _, _, first = words(b, offs[i : j + 1])
                v, at = gram_sets(h, first, n)
                for r in range(j - i):
                    if (cell[i + r], part[i + r]) != key:
                        end()
                        key, held = (cell[i + r], part[i + r]), ([], [], [], [], [])
                    x = v[at[r] : at[r + 1]]
                    if member[i + r]:
                        # a repeated row of an id counts once
                        if not held[0] or held[0][-1] != doc[i + r]:
                            for into, y in zip(held, (doc[i + r], copies[i + r], x.copy(), own[i + r], opens[i + r])):
                                into.append(y)
                    else:
                        if group is None:
                            begin()
                            last = None
                        if doc[i + r] != last:
                            last = doc[i + r]
                            compare(last, copies[i + r], x, opens[i + r])
                    if len(out) > 100_000:
                        yield flush()
        end()
        if out:
            yield flush()

    return run


def _representatives(docs: DataFrame, n: int, group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, rep) of all documents with words; the representatives as (doc_id, n, copies, grp), groups of at most about `group`; and (doc_id, n, bits) of all documents with words."""
    sketch = docs.mapInArrow(_sketcher(n), "doc_id long, n int, d1 long, d2 long, grp long, bits binary")
    sketch = materialize(sketch.withColumn("grp", F.xxhash64("grp", F.floor(F.log("n") / F.log(F.lit(SIZES))))), "sketch")
    digest = ["d1", "d2", "n"]
    reps = sketch.groupBy(*digest).agg(F.min(F.struct("doc_id", "grp")).alias("x"), F.count_distinct("doc_id").alias("copies")).select(*digest, "x.*", "copies")
    reps = materialize(reps, "reps")
    # any division into groups is right, so a hot one is divided further
    hot = reps.groupBy("grp").agg(F.count("*").alias("c")).where(F.col("c") > group)
    cut = reps.join(hot, "grp", "left").withColumn("grp", F.when(F.col("c").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", F.expr(f"pmod(xxhash64(doc_id), cast(ceil(c / {group}) as bigint))")))).drop("c")
    of = sketch.select("doc_id", *digest).join(reps.select(F.col("doc_id").alias("rep"), *digest), digest).select("doc_id", "rep").distinct()
    return of, cut.select("doc_id", "n", "copies", "grp"), sketch.select("doc_id", "n", "bits")


def _compared(docs: DataFrame, reps: DataFrame, bits: DataFrame, n: int, threshold: float, group: int, classes: bool) -> DataFrame:
    """(doc_a, doc_b, value) as _opener() gives it, of the representatives."""
    # the matrix: tokens that occur in several groups
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, n))
    hint = F.broadcast if reps.count() <= BROADCAST_ROWS else lambda x: x
    tokens = docs.mapInArrow(_grams(n, common, threshold), "doc_id long, tokens array<long>").join(hint(reps.select("doc_id", "grp")), "doc_id")
    tokens = tokens.select("doc_id", "grp", F.explode("tokens").alias("token"))
    by = Window.partitionBy("token")
    shared = tokens.withColumns({"lo": F.min("grp").over(by), "hi": F.max("grp").over(by)}).where("lo <> hi").select("token", "doc_id", "grp")
    # rows that repeat an id count once
    written = shared = materialize(shared.distinct(), "tokens")
    release(docs.sparkSession)
    # groups whose sizes rule out every member are left out before anything is counted
    t = threshold
    sizes = reps.groupBy(F.col("grp").alias("g")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    # by token from the start, so that the index is shuffled once for being distinct and joined
    shared = shared.repartition("token")
    index = shared.select("token", F.col("grp").alias("g")).distinct().join(hint(sizes), "g")
    hits = shared.join(hint(reps.select("doc_id", "n")), "doc_id").join(index, "token").where(f"grp < g and most >= {t} * n - 1e-6 and {t} * least <= n + 1e-6")
    hits = hits.groupBy("doc_id", "g").agg(F.count("*").alias("hits"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"))
    # the bound: a document of n n-grams and a member of b have t / (1 + t) * (n + b) in common or more, and fewer than t * n or t * b of them are no tokens
    own = f"{t / (1 + t)} * (n + greatest(least, {t} * n)) - {t} * n"
    other = f"{t / (1 + t)} * (n + least(most, n / {t})) - {t} * least(most, n / {t})"
    opened = materialize(hits.where(f"hits >= least({own}, {other}) - 1e-6").select("doc_id", F.col("g").alias("grp")), "opened")
    release(docs.sparkSession, written)

    of = reps.select("doc_id", "copies", "grp")
    return _sets(docs, of, opened, bits, threshold, group).mapInArrow(_opener(n, threshold, classes), "doc_a long, doc_b long, value double")


def _cells(of: DataFrame, opened: DataFrame, group: int) -> DataFrame:
    """(grp, cell) of the groups with something to compare. Any division is right; groups take, twice, the least label of those that they open or that open them, which brings the groups of a cluster together."""
    edges = opened.join(of.select("doc_id", F.col("grp").alias("own")), "doc_id").select(F.col("own").alias("a"), F.col("grp").alias("b")).distinct()
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
    label = edges.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("label"))
    size = of.groupBy("grp").agg(F.count("*").alias("c"))
    known = size.join(label.withColumnRenamed("a", "grp"), "grp", "left").where("c > 1 or label is not null").withColumn("label", F.coalesce("label", "grp"))
    known = materialize(known, "labels")
    whole = known.groupBy("label").agg(F.ceil(F.sum("c") / group).alias("pieces"))
    return materialize(known.join(whole, "label").select("grp", F.xxhash64("label", F.pmod(F.xxhash64("grp", F.lit(3)), F.col("pieces"))).alias("cell")), "cells")


def _sets(docs: DataFrame, of: DataFrame, opened: DataFrame, bits: DataFrame, threshold: float, group: int) -> DataFrame:
    """(cell, part, doc_id, copies, member, grp, opens, text) as _opener() takes them. A text is sent once to each cell where it is a member or opens groups, members of cells in parts to every part, but only where the bitmaps leave something to compare it with."""
    cells = _cells(of, opened, group)
    hint = F.broadcast if cells.count() <= BROADCAST_ROWS else lambda x: x
    asks = opened.join(hint(cells), "grp").groupBy("doc_id", "cell").agg(F.collect_set("grp").alias("opens"))
    home = of.join(hint(cells), "grp").select("doc_id", "cell", "copies", "grp")
    both = home.select("doc_id", "cell", F.lit(True).alias("member")).join(asks, ["doc_id", "cell"], "full").join(of, "doc_id")
    both = materialize(both.select("doc_id", "cell", F.coalesce("member", F.lit(False)).alias("member"), "copies", "grp", F.coalesce("opens", F.expr("array()").cast("array<long>")).alias("opens")), "asks")
    # a cell that many queries open is compared in parts, each with all its members
    parts = both.where("not member").groupBy("cell").agg(F.ceil(F.count("*") / (4 * group)).cast("int").alias("parts")).where("parts > 1")
    both = both.join(parts, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("its", F.expr("cast(pmod(xxhash64(doc_id, 7), parts) as int)"))
    each = F.when(F.col("member"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("its"))
    rows = both.withColumn("part", F.explode(each)).select("cell", "part", "doc_id", "copies", "member", "grp", F.when(F.col("part") == F.col("its"), F.col("opens")).alias("opens"))
    rows = materialize(rows, "compare")
    few = F.broadcast if rows.count() <= BROADCAST_ROWS // 4 else lambda x: x
    maps = bits.join(few(rows), "doc_id").select("cell", "part", "doc_id", "n", "member", "grp", "opens", "bits")
    near = maps.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("member").desc(), "doc_id").mapInArrow(_screener(threshold), "cell long, part int, doc_id long")
    rows = materialize(rows.join(near, ["cell", "part", "doc_id"], "left_semi"), "near")
    few = F.broadcast if rows.count() <= BROADCAST_ROWS // 4 else lambda x: x
    # a document's texts are equal in n-grams if its id repeats: any one of them serves as the representative's
    texts = docs.join(few(rows), "doc_id").select("cell", "part", "doc_id", "copies", "member", "grp", "opens", "text")
    return texts.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("member").desc(), "doc_id")


def _read(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b.

    Documents of equal n-gram sets: their least id is the representative, and each other one has one row with it, of
    similarity 1. Of different sets, the representatives of all pairs that reach the threshold are given; pairs of
    their copies follow from these rows. A text of fewer than n words, but some, has all its words as its one n-gram.
    Nulls in doc_id or text, and texts without words, join nothing; an empty table gives no rows. Rows that repeat
    a doc_id with the same text count once; ids are expected to be unique otherwise. Other columns are ignored.
    Rows are as many as the pairs: near_duplicate_classes() tells as much of each document in one row.
    """
    docs = _read(docs)
    of, reps, bits = _representatives(docs, n, group)
    copies = of.where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return _compared(docs, reps, bits, n, threshold, group, classes=False).withColumnRenamed("value", "jaccard").unionByName(copies)


def near_duplicate_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(doc_id, class_id, links), one row for each document with words.

    links is the number of other documents, copies among them, that reach the threshold; classes are what links
    connect, named by their least doc_id. Nulls, texts without words and repeated rows are as in ngram_jaccard_join().
    """
    docs = _read(docs)
    of, reps, bits = _representatives(docs, n, group)
    of, reps = materialize(of, "copies"), materialize(reps, "groups")
    got = materialize(_compared(docs, reps, bits, n, threshold, group, classes=True), "compared")
    near = got.where("doc_b is null").groupBy(F.col("doc_a").alias("rep")).agg(F.sum("value").cast("long").alias("near"))
    root = components(got.where("doc_b is not null").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))).select(F.col("node").alias("rep"), "root")
    # of a class, the least representative is its least document
    out = of.join(reps.select(F.col("doc_id").alias("rep"), "copies"), "rep").join(near, "rep", "left").join(root, "rep", "left")
    return out.select("doc_id", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))


def near_duplicate_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keeper): connected groups of the join's pairs, each with its least doc_id; ungrouped documents are absent."""
    return near_duplicate_classes(docs, n, threshold).where("links > 0").select("doc_id", F.col("class_id").alias("keeper"))


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, of each group of near duplicates only those of its least doc_id. Documents that join nothing stay, null ids too; rows that repeat a kept id all stay."""
    # of what is written on the way only the ids to leave out are kept
    with scratch(docs.sparkSession) as written:
        lose = materialize(near_duplicate_groups(docs, n, threshold).where("doc_id <> keeper").select(F.col("doc_id").alias("_lost")), "lost")
        written.pop()
    # where the caller deletes what is written, it does so with this too
    release(docs.sparkSession)
    # texts stay where they are while those ids are few enough to be sent to them
    hint = F.broadcast if lose.count() <= BROADCAST_ROWS else lambda x: x
    plain = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    return plain.join(hint(lose), plain[f"_{docs.columns.index('doc_id')}"] == lose["_lost"], "left_anti").toDF(*docs.columns)


def _sql(n: int = N, threshold: float = THRESHOLD) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+') as w from documents where text is not null and doc_id is not null),
s as materialized (select distinct doc_id, case when len(w) < {n} then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}))) end as s from w where len(w) > 0),
r as materialized (select min(doc_id) as rep, count(*) as copies, s from s group by s),
t as (select rep, len(s) as n, unnest(s) as g from r),
c as (select a.rep as a, b.rep as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from t a join t b on a.g = b.g and a.rep < b.rep group by 1, 2),
p as materialized (select a, b from c where c / (na + nb - c) >= {threshold}),
e as materialized (select a, b from p union all select b, a from p),
l as (select a as rep, sum(copies) as near from e join r on r.rep = e.b group by 1),
-- the least representative that can be reached
f(rep, root) as (select rep, rep from r union select e.b, f.root from f join e on e.a = f.rep where f.root < e.b),
k as (select rep, min(root) as root from f group by 1)
select doc_id, k.root as class_id, (copies - 1 + coalesce(near, 0))::bigint as links
from s join r on s.s = r.s join k using (rep) left join l using (rep)
"""


ORACLE_SQL = _sql()


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
