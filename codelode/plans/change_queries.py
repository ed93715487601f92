"""Registered queries: snapshots, evaluation, traces and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import snapshots as S
from ..streaming import windows as W
from . import lexical_queries as LQ
from . import relations as R


def _base(spark, sf: str) -> DataFrame:
    """All documents but those of src5."""
    return R.table(spark, sf, "documents").where("source <> 'src5'").select(R.doc_path().alias("path"), "doc_id", F.md5("text").alias("hash"), "source", "lang")


def _current(spark, sf: str) -> DataFrame:
    """All but those of src3; German ones of src1 moved, texts of src7 edited."""
    text = F.when(F.col("source") == "src7", F.concat("text", F.lit("\nedited"))).otherwise(F.col("text"))
    path = F.when((F.col("source") == "src1") & (F.col("lang") == "de"), F.concat(F.lit("moved/"), R.doc_path())).otherwise(R.doc_path())
    return R.table(spark, sf, "documents").where("source <> 'src3'").select(path.alias("path"), "doc_id", F.md5(text).alias("hash"), "source", "lang")


def snapshot_delta(spark, sf: str) -> DataFrame:
    return S.delta(_base(spark, sf), _current(spark, sf))


def apply_delta(spark, sf: str) -> DataFrame:
    """The base's table after the changes."""
    rows = lambda x: x.select(F.col("path").alias("file_path"), "hash")
    return S.apply_delta(rows(_base(spark, sf)), snapshot_delta(spark, sf), rows(_current(spark, sf)))


def delta_equals_rebuild(spark, sf: str) -> DataFrame:
    """No rows: the updated table is what a rebuild gives."""
    return S.differences(apply_delta(spark, sf), _current(spark, sf).select(F.col("path").alias("file_path"), "hash"))


def rename_propagate(spark, sf: str) -> DataFrame:
    """References with the moved files' new paths at both ends."""
    changes = R.saved(snapshot_delta(spark, sf), "changes")
    return S.rename(R.file_edges(spark, sf), changes, ["source", "target"])


def change_ratio(spark, sf: str) -> DataFrame:
    return S.change_ratio(snapshot_delta(spark, sf), _current(spark, sf))


def mtime_delta(spark, sf: str) -> DataFrame:
    """Event types by user as files: stored are those of users with purchases, found all but sign-ups, changed in the second half of the month."""
    e = R.table(spark, sf, "events")
    path = F.concat(F.lit("u"), "user_id", F.lit("/"), "event_type")
    stored = e.where("event_type <> 'view'").select(path.alias("path"))
    found = e.where("event_type <> 'signup'").groupBy(path.alias("path")).agg(F.max("ts").alias("mtime"))
    return S.mtime_delta(stored, found, F.lit("2024-01-29").cast("timestamp_ntz"))


def cache_ttl(spark, sf: str) -> DataFrame:
    """Entries made by each user's last event, seen from the end of the month."""
    e = R.table(spark, sf, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("key")).agg(F.max("ts").cast("timestamp").alias("created_at"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return S.stale(e, F.lit("2024-01-31 00:00:00").cast("timestamp"), 4).select("key", "stale")


def trace_summary(spark, sf: str) -> DataFrame:
    return E.trace_summary(R.table(spark, sf, "events").select(F.col("event_type").alias("step"), F.col("value").alias("ms")))


def _judged(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Ranked files of every benchmark item by BM25, and the files that hold its whole text."""
    paths = R.chunks(spark, sf).select("chunk_id", "file_path")
    ranked = R.few(LQ.bm25_topk(spark, sf)).join(paths, "chunk_id").select(F.col("query_id").alias("task_id"), "file_path", F.col("rank").alias("pos"))
    expected = R.few(LQ.phrase_match(spark, sf)).join(paths, "chunk_id").select(F.col("query_id").alias("task_id"), "file_path")
    return ranked, expected


def quality_metrics(spark, sf: str) -> DataFrame:
    return E.metrics(*_judged(spark, sf))


def _results(spark, sf: str) -> DataFrame:
    m = R.saved(quality_metrics(spark, sf), "metrics")
    return m.select("task_id", F.lit("bm25").alias("strategy"), *m.columns[1:]).union(m.select("task_id", F.lit("halved").alias("strategy"), *[F.round(F.col(c) / 2, 6) for c in m.columns[1:]]))


def quality_gate(spark, sf: str) -> DataFrame:
    return E.gate(_results(spark, sf), by_strategy={"halved": {"mrr": 0.2}})


def baseline_compare(spark, sf: str) -> DataFrame:
    r = R.saved(_results(spark, sf), "results")
    base = r.where("strategy = 'bm25'")
    return E.compare_baseline(r.where("strategy = 'halved'").withColumn("strategy", F.lit("bm25")), base).select("task_id", "metric", "regression")


def strategy_summary(spark, sf: str) -> DataFrame:
    return E.summary(_results(spark, sf), ["strategy"])


def win_counts(spark, sf: str) -> DataFrame:
    return E.win_counts(_results(spark, sf))


def token_savings(spark, sf: str) -> DataFrame:
    c = R.chunks(spark, sf).groupBy("language").agg(F.sum("token_count").alias("raw_tokens"), F.max("token_count").alias("out_tokens"))
    return E.savings(c.select(F.col("language").alias("task_id"), "raw_tokens"), c.select(F.col("language").alias("task_id"), "out_tokens"))


def latency_warnings(spark, sf: str) -> DataFrame:
    e = R.table(spark, sf, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("strategy"), F.col("value").alias("wall_time_ms"))
    return E.latency_warnings(e, 50.0)


def delta_gate(spark, sf: str) -> DataFrame:
    e = R.table(spark, sf, "events").groupBy(F.col("user_id").alias("task_id")).agg((F.max("value") / F.avg("value")).alias("speedup"), (F.max(F.when(F.col("event_type") == "error", F.col("value"))) < 200).alias("correct"))
    return E.delta_gate(e, 5.0)


def _window(df: DataFrame, key: str) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.select(at("window.start").alias("start"), at("window.end").alias("stop"), key, *[c for c in df.columns if c not in ("window", key)])


def stream_tumbling(spark, sf: str) -> DataFrame:
    return _window(W.drain(W.tumbling(W.read_events(spark, sf))), "event_type")


def stream_sliding(spark, sf: str) -> DataFrame:
    return _window(W.drain(W.sliding(W.read_events(spark, sf))), "event_type")


def stream_session(spark, sf: str) -> DataFrame:
    return W.drain(W.sessions(W.read_events(spark, sf))).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def stream_dedupe(spark, sf: str) -> DataFrame:
    return W.drain(W.deduplicated(W.read_events(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"]), "append")


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_delta, apply_delta, delta_equals_rebuild, rename_propagate, change_ratio, mtime_delta, cache_ttl, trace_summary, quality_metrics, quality_gate, baseline_compare, strategy_summary, win_counts,
        token_savings, latency_warnings, delta_gate, stream_tumbling, stream_sliding, stream_session, stream_dedupe,
    )
}

_SNAP = f"""b as (select {R.DOC_PATH} as path, md5(text) as hash from documents where source <> 'src5'),
c as (select case when source = 'src1' and lang = 'de' then 'moved/' else '' end || {R.DOC_PATH} as path, md5(case when source = 'src7' then text || chr(10) || 'edited' else text end) as hash from documents where source <> 'src3'),
fo as (select coalesce(b.path, c.path) as path, b.hash as was, c.hash as now from b full join c on b.path = c.path),
gone as (select path as old_path, was as hash, row_number() over (partition by was order by path) as n from fo where now is null), fresh as (select path, now as hash, row_number() over (partition by now order by path) as n from fo where was is null),
delta as (select path, 'M' as status, null as old_path from fo where was <> now union all select coalesce(path, old_path), case when path is null then 'D' when old_path is null then 'A' else 'R' end, case when path is not null then old_path end from gone full join fresh using (hash, n))"""
_EVAL = LQ.BM25.rpartition("\nselect query_id, chunk_id,  score, rank")[0] + ",\nhit as (" + LQ._top("select query_id, chunk_id, sum(c) as score from contrib group by all") + f"""),
ct as (select chunk_id, file_path, ' ' || array_to_string({R.tok("content")}, ' ') || ' ' as t from chunks), qq as (select query_id, ' ' || array_to_string({R.tok("question")}, ' ') || ' ' as p from questions),
e as (select query_id as task_id, file_path from ct join qq on contains(t, p)), want as (select task_id, count(*) as want from e group by 1),
r as (select query_id as task_id, file_path, rank from hit join chunks using (chunk_id)), hh as (select r.*, row_number() over (partition by task_id order by rank) as h from r semi join e using (task_id, file_path)),
g as (select task_id, count(*) as found, min(rank) as first, sum(case when rank <= 10 then 1 / log2(rank + 1) end) as dcg, sum(h / rank::double) as ap from hh group by 1), sn as (select task_id, count(*) as shown from r group by 1),
m0 as (select task_id, coalesce(found, 0) / want::double as recall, coalesce(coalesce(found, 0) / shown::double, 0) as precision, coalesce(1 / first::double, 0) as mrr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(want, 10) + 1), lambda i: 1 / log2(i + 1))) as ndcg, coalesce(ap, 0) / want as map_score from want left join sn using (task_id) left join g using (task_id)),
m as (select task_id, round(recall, 6) as recall, round(precision, 6) as precision, round(case when recall + precision > 0 then 2 * recall * precision / (recall + precision) else 0 end, 6) as f1_score, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg, round(map_score, 6) as map_score from m0),
res as (select task_id, 'bm25' as strategy, m.* exclude (task_id) from m union all select task_id, 'halved', round(recall / 2, 6), round(precision / 2, 6), round(f1_score / 2, 6), round(mrr / 2, 6), round(ndcg / 2, 6), round(map_score / 2, 6) from m),
lo as (unpivot res on recall, precision, f1_score, mrr, ndcg, map_score into name metric value actual)
"""
_WIN = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
SQL = {
    "snapshot_delta": f"with {_SNAP} select * from delta",
    "apply_delta": f"with {_SNAP} select path as file_path, hash from c",
    "delta_equals_rebuild": "select '' as file_path, '' as hash, '' as side where false",
    "rename_propagate": R.with_(_SNAP, R.FILE_EDGES.replace("paths as", "paths as")) + " select coalesce(a.path, source) as source, coalesce(z.path, target) as target from edges left join delta a on a.status = 'R' and a.old_path = source left join delta z on z.status = 'R' and z.old_path = target",
    "change_ratio": f"with {_SNAP} select (select count(*) from delta) as changed, count(*) as total, round((select count(*) from delta) / count(*)::double, 6) as ratio, (select count(*) from delta) / count(*)::double >= 0.5 as full from c",
    "mtime_delta": """with s as (select distinct 'u' || user_id || '/' || event_type as path from events where event_type <> 'view'), f as (select 'u' || user_id || '/' || event_type as path, max(ts) as mtime from events where event_type <> 'signup' group by 1),
x as (select coalesce(s.path, f.path) as path, case when mtime is null then 'D' when s.path is null then 'A' when mtime > timestamp '2024-01-29' then 'M' end as status from s full join f on s.path = f.path) select * from x where status is not null""",
    "cache_ttl": "select 'u' || user_id as key, floor(epoch(timestamp '2024-01-31')) - floor(epoch(max(ts))) > 4 * 3600 as stale from events group by user_id",
    "trace_summary": "select event_type as step, count(*) as calls, round(sum(value), 3) as total_ms, round(avg(value), 3) as mean_ms, max(value) as max_ms from events group by 1",
    "quality_metrics": _EVAL + "select * from m",
    "quality_gate": _EVAL + "select task_id, strategy, metric, threshold, actual from (select *, case when strategy = 'halved' and metric = 'mrr' then 0.2::double else (map {'recall': 0.6::double, 'precision': 0.2::double, 'f1_score': 0.3::double, 'mrr': 0.55::double, 'ndcg': 0::double, 'map_score': 0::double})[metric] end as threshold from lo) where actual < threshold",
    "baseline_compare": _EVAL + "select a.task_id, a.metric, a.actual < b.actual - 0.05::double as regression from lo a join lo b on a.task_id = b.task_id and a.metric = b.metric where a.strategy = 'halved' and b.strategy = 'bm25'",
    "strategy_summary": _EVAL + "select strategy, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(f1_score), 6) as f1_score, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, round(avg(map_score), 6) as map_score, count(*) as tasks from res group by 1",
    "win_counts": _EVAL + "select strategy, metric, count(*) as wins from (select *, row_number() over (partition by task_id, metric order by actual desc, strategy) as r from lo) where r = 1 group by all",
    "token_savings": f"with t as (select lang, floor(len({R.blanks('text')}) * 1.3::double)::bigint as n from documents) select lang as task_id, sum(n)::bigint as raw_tokens, max(n) as out_tokens, round(100 * (1 - max(n) / sum(n)::double), 1) as savings_pct from t group by 1",
    "latency_warnings": "select event_id as task_id, event_type as strategy, value as wall_time_ms from events where value > 50",
    "delta_gate": """with r as (select user_id as task_id, max(value) / avg(value) as speedup, max(value) filter (event_type = 'error') < 200 as correct from events group by 1)
select task_id, 'speedup' as violation from r where speedup < 5 union all select task_id, 'correctness' from r where not correct""",
    "stream_tumbling": f"select {_WIN.format("date_trunc('day', ts)")} as start, {_WIN.format("date_trunc('day', ts) + interval 1 day")} as stop, event_type, count(*) as n, max(value) as max_ms from events group by all",
    "stream_sliding": f"with w as (select date_trunc('day', ts) - to_days(k::int) as s, event_type, value from events, range(0, 2) t(k)) select {_WIN.format('s')} as start, {_WIN.format('s + interval 2 day')} as stop, event_type, count(*) as n, max(value) as max_ms from w group by all",
    "stream_session": """with a as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from a),
n as (select user_id, s, count(*) as n from s group by all) select user_id, count(*) as sessions, max(n) as longest from n group by 1""",
    "stream_dedupe": "select distinct user_id, event_type from events",
}
