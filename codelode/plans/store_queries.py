"""Registered queries: the store of an index and the cache."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store as S
from ..storage import shared_folder
from . import relations as R


def _store(spark, sf: str) -> S.Store:
    """Chunks, edges and surrogates of all documents in a store of its own."""
    c = R.chunks(spark, sf).select("chunk_id", "file_path", "symbol_kind", "token_count")
    store = S.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.write({"source": "documents"}, chunks=c, edges=R.file_edges(spark, sf), surrogates=c.select("chunk_id", "file_path", F.concat("symbol_kind", F.lit(" "), "file_path").alias("surrogate")))
    return store


def store_lookup(spark, sf: str) -> DataFrame:
    """Chunks by the ids of another table, which are any number."""
    wanted = R.table(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("id"))
    return _store(spark, sf).lookup("chunks", "chunk_id", wanted).select("chunk_id", "file_path", "symbol_kind", "token_count")


def store_surrogates(spark, sf: str) -> DataFrame:
    """Surrogates of the files of one folder for each source."""
    paths = R.chunks(spark, sf).where("language = 'fr'").select("file_path")
    return _store(spark, sf).lookup("surrogates", "file_path", paths).select("chunk_id", "file_path", "surrogate")


def store_upsert(spark, sf: str) -> DataFrame:
    """Chunks after those of one language came again with another kind."""
    store = _store(spark, sf)
    store.upsert("chunks", store.table("chunks").where("file_path like '%/de/%'").withColumn("symbol_kind", F.lit("edited")), "chunk_id")
    return store.table("chunks").groupBy("symbol_kind").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def store_replace(spark, sf: str) -> DataFrame:
    """Rows by table after one source's files were replaced, each by its first half."""
    store = _store(spark, sf)
    paths = store.table("chunks").where("file_path like 'src1/%'").select(F.col("file_path").alias("path"))
    new = store.table("chunks").where("file_path like 'src1/%'").withColumn("token_count", F.expr("token_count div 2"))
    edges = paths.select(F.col("path").alias("source"), F.lit("new").alias("target"))
    store.replace_files(paths, new, edges)
    c = store.table("chunks").groupBy(F.split("file_path", "/")[0].alias("part")).agg(F.count("*").alias("n"), F.sum("token_count").alias("total"))
    e = store.table("edges").groupBy(F.concat(F.lit("edges of "), F.split("source", "/")[0]).alias("part")).agg(F.count("*").alias("n"), F.sum((F.col("target") == "new").cast("long")).alias("total"))
    return c.unionByName(e)


def cache_entries(spark, sf: str) -> DataFrame:
    """Each region's nations cached in turn, an hour apart; what is there after a day, seen from the last one."""
    cache, start = S.Cache(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"), 1_700_000_000
    names = [r[0] for r in R.table(spark, sf, "region").select("r_name").orderBy("r_regionkey").collect()]  # five rows
    n = R.table(spark, sf, "nation")
    for k, name in enumerate(names):
        cache.put(hashlib.sha256(name.encode()).hexdigest(), start + 3600 * k, f"c{k}", name, nations=n.where(F.col("n_regionkey") == k))
    cache.clean(2.5, start + 3600 * (len(names) - 1))
    return cache.list_entries().select("key", "created_at", "commit", "identity")


def name_status(spark, sf: str) -> DataFrame:
    """Status lines made of the users' events."""
    e = R.table(spark, sf, "events").select("event_type", "user_id").distinct()
    kind = F.when(F.col("event_type") == "view", F.lit("M\t")).when(F.col("event_type") == "click", F.concat(F.lit("R09"), F.pmod("user_id", F.lit(10)).cast("string"), F.lit("\told/u"), "user_id", F.lit("\t"))).when(F.col("event_type") == "purchase", F.lit("D\t")).otherwise(F.lit("X\t"))
    x = e.select(S.name_status(F.concat(kind, F.lit("u"), "user_id")).alias("x")).where("x is not null").select("x.*")
    return x.groupBy("status", "path", "old_path").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (store_lookup, store_surrogates, store_upsert, store_replace, cache_entries, name_status)}

_C = R.with_(R.CHUNKS)
SQL = {
    "store_lookup": _C + " select chunk_id, file_path, symbol_kind, token_count from chunks where chunk_id in (select item_id * 3 from benchmark)",
    "store_surrogates": _C + " select chunk_id, file_path, symbol_kind || ' ' || file_path as surrogate from chunks where language = 'fr'",
    "store_upsert": _C + " select case when file_path like '%/de/%' then 'edited' else symbol_kind end as symbol_kind, count(*) as n, sum(token_count)::bigint as tokens from chunks group by 1",
    "store_replace": R.with_(R.CHUNKS, R.FILE_EDGES) + """ select split_part(file_path, '/', 1) as part, count(*) as n, sum(case when file_path like 'src1/%' then token_count // 2 else token_count end)::bigint as total from chunks group by 1
union all select 'edges of ' || split_part(source, '/', 1), count(*), sum((target = 'new')::bigint)::bigint from
  (select source, target from edges where source not like 'src1/%' and target not like 'src1/%' union all select file_path, 'new' from chunks where file_path like 'src1/%') group by 1""",
    "cache_entries": """with r as (select *, row_number() over (order by r_regionkey) - 1 as k, count(*) over () as n from region)
select sha256(r_name) as key, (1700000000 + 3600 * k)::double as created_at, 'c' || k as commit, r_name as identity from r where n - 1 - k <= 2.5""",
    "name_status": """with e as (select distinct event_type, user_id from events)
select case event_type when 'view' then 'M' when 'click' then 'R' else 'D' end as status, 'u' || user_id as path, case when event_type = 'click' then 'old/u' || user_id end as old_path, count(*) as n
from e where event_type in ('view', 'click', 'purchase') group by all""",
}
