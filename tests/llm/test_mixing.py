import hashlib
import math
from collections import Counter, defaultdict

from helpers import assert_same

from codelode.llm import mixing as M


def brute(docs, weights, block, share=M.SHARE):
    streams = defaultdict(list)
    for i, s, t in docs:
        n = len((t or "").split())
        if n:
            key = hashlib.md5(f"{M.SEED}:{-1 if i is None else i}".encode()).hexdigest()
            streams[s or ""].append((key, -1 if i is None else i, i, n))
    out, total = [], {s: sum(x[3] for x in v) for s, v in streams.items()}
    names = [s for s in sorted(total) if weights.get(s, 0) > 0]
    whole, stretch, lo = sum(weights[s] for s in names), {}, 0
    for s in names:
        width = 1 + math.floor(weights[s] / whole * (M._M - 1 - len(names)))
        stretch[s], lo = (lo, lo + width), lo + width
    blocks = {s: -(-total[s] // block) for s in names}
    # slots by bisection: what all sources together have placed by then
    ends = sorted((blocks[s] * M._M / (stretch[s][1] - stretch[s][0]), s) for s in names)
    target, n_slots = math.ceil(sum(blocks.values()) * share), 0
    for k, (end, s) in enumerate(ends):
        n_slots = math.ceil((target - sum(blocks[x] for _, x in ends[:k])) * (M._M / (lo - sum(stretch[x][1] - stretch[x][0] for _, x in ends[:k]))))
        if n_slots <= math.ceil(end):
            n_slots += 2 * len(names)
            break
    taken, pieces = Counter(), defaultdict(list)
    for s, v in streams.items():
        at = 0
        for _, _, i, n in sorted(v):
            for b in range(at // block, (at + n - 1) // block + 1):
                pieces[s, b].append((i, max(0, b * block - at), min(n, (b + 1) * block - at)))
            at += n
    for slot in range(n_slots):
        p = slot * M._G % M._M
        s = next((s for s in names if stretch[s][0] <= p < stretch[s][1]), None)
        if s is None or taken[s] == blocks[s]:
            continue
        for i, a, e in pieces.get((s, taken[s]), []):
            out.append((slot, s, taken[s], i, a, e))
        taken[s] += 1
    return sorted(out, key=repr), taken


DOCS = [(k, "abc"[k % 3 if k % 5 else 0], " ".join(["x"] * (k * 7 % 23))) for k in range(300)] + [(None, "b", "u v w"), (5, None, "q q"), (7, "c", None), (8, "c", ""), (8, "a", "same row"), (8, "a", "same row")]


def test_brute_force_and_proportions(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, source string, text string")
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    want, taken = brute(DOCS, w, 16)
    assert sorted(map(tuple, M.mix_sources(df, w, block=16).collect()), key=repr) == want
    # all of the sources, and no share over 90 % by more than rounding
    assert 0.85 * 300 < len({r[3] for r in want if r[3] is not None}) <= 300
    # until a source is used up, proportions hold
    first = Counter(s for slot, s in {(r[0], r[1]) for r in want} if slot < 40)
    assert all(abs(first[s] - w[s] * sum(first.values())) <= 3 for s in w)


def test_a_tiny_source_does_not_end_the_schedule(spark):
    docs = [(k, "big" if k % 2 else "other", "x " * 40) for k in range(400)] + [(1000, "tiny", "x y z")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    kept = M.keep_mixed(df, block=16).collect()
    assert 0.88 * 401 <= len(kept) <= 0.94 * 401
    everything = M.mix_sources(df, block=16, share=1.0)
    assert sum(r.to_token - r.from_token for r in everything.collect()) >= 0.99 * (400 * 40 + 3)


def test_very_many_sources(spark):
    n = 100_000
    df = spark.range(n + 2000).selectExpr("id as doc_id", f"case when id < {n} then concat('s', id) else 'hot' end as source", "'a b c d' as text")
    for broadcast in (10 * n, 0):
        M.BROADCAST_SOURCES, was = broadcast, M.BROADCAST_SOURCES
        kept = M.keep_mixed(df, block=4).count()
        M.BROADCAST_SOURCES = was
        assert 0.85 * n < kept <= n + 2000


def test_no_token_twice(spark):
    df = spark.createDataFrame(DOCS[:300], "doc_id long, source string, text string")
    spans = defaultdict(list)
    for r in M.mix_sources(df, {"a": 1, "b": 1, "c": 1}, block=16).collect():
        spans[r.doc_id].append((r.from_token, r.to_token))
    for v in spans.values():
        v.sort()
        assert all(a[1] <= b[0] for a, b in zip(v, v[1:]))


def test_sql(spark, tiny):
    assert_same(M.query(spark, tiny), M.ORACLE_SQL, tiny)


def test_kept_rows_are_those_whose_first_token_is_scheduled(spark):
    rows = [(i, s, t) for i, s, t in DOCS[:300]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    w = {"a": 0.6, "b": 0.2, "c": 0.2}
    first = {r.doc_id for r in M.mix_sources(df, w, block=16).collect() if r.from_token == 0}
    kept = {r.doc_id for r in M.keep_mixed(df, w, block=16).collect()}
    has = {i for i, _, t in rows if t}
    assert kept & has == first
