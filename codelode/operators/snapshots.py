"""Changes between snapshots of files, and keeping derived tables up to date with them.

A snapshot is rows (path, hash, ...). Everything is joins on paths and hashes; no file is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(base: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status, old_path): M modified, A added, D deleted, R renamed. A rename joins a deleted and an added path of equal content; equal contents pair up in order of path."""
    both = base.select("path", F.col("hash").alias("was")).join(current.select("path", F.col("hash").alias("now")), "path", "full")
    changed = both.where("was is not null and now is not null and was <> now").select("path", F.lit("M").alias("status"), F.lit(None).cast("string").alias("old_path"))
    n = lambda h: F.row_number().over(Window.partitionBy(h).orderBy("path"))
    gone = both.where("now is null").select(F.col("path").alias("old_path"), F.col("was").alias("hash"), n("was").alias("n"))
    new = both.where("was is null").select("path", F.col("now").alias("hash"), n("now").alias("n"))
    pair = gone.join(new, ["hash", "n"], "full")
    status = F.when(F.col("path").isNull(), "D").when(F.col("old_path").isNull(), "A").otherwise("R")
    moved = pair.select(F.coalesce("path", "old_path").alias("path"), status.alias("status"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"))
    return changed.union(moved)


def mtime_delta(stored: DataFrame, found: DataFrame, since: Column) -> DataFrame:
    """(path, status) of found (path, mtime) against stored (path): A new, D gone, M changed after `since`."""
    s = stored.select("path").distinct().withColumn("in_store", F.lit(True))
    x = found.select("path", "mtime").join(s, "path", "full")
    status = F.when(F.col("mtime").isNull(), "D").when(F.col("in_store").isNull(), "A").when(F.col("mtime") > since, "M")
    return x.select("path", status.alias("status")).where("status is not null")


def apply_delta(table: DataFrame, changes: DataFrame, fresh: DataFrame, path: str = "file_path") -> DataFrame:
    """table after changes: rows of changed and deleted files go, renamed ones take the new path, rows of fresh (of changed and added files) come."""
    c = changes.select("path", "status", "old_path")
    gone = c.where("status in ('M', 'D', 'A')").select(F.col("path").alias(path))
    new_path = c.where("status = 'R'").select(F.col("old_path").alias(path), F.col("path").alias("_new"))
    kept = table.join(gone, path, "left_anti").join(new_path, path, "left").withColumn(path, F.coalesce("_new", path)).select(table.columns)
    come = fresh.join(c.where("status in ('M', 'A')").select(F.col("path").alias(path)), path, "left_semi")
    return kept.unionByName(come.select(table.columns))


def rename(table: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """table with the renamed paths in all of the columns."""
    out = table
    for c in columns:
        m = changes.where("status = 'R'").select(F.col("old_path").alias(c), F.col("path").alias("_new"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(table.columns)


def change_ratio(changes: DataFrame, current: DataFrame) -> DataFrame:
    """(changed, total, ratio, full): whether so much has changed that everything should be derived anew."""
    x = changes.agg(F.count("*").alias("changed")).crossJoin(current.agg(F.count("*").alias("total")))
    r = F.when(F.col("total") > 0, F.col("changed") / F.col("total")).otherwise(1.0)
    return x.select("changed", "total", F.round(r, 6).alias("ratio"), (r >= 0.5).alias("full"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in only one of two tables, with side 'a' or 'b'; none if an update equals a rebuild."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def stale(entries: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """entries (key, created_at) with stale."""
    return entries.withColumn("stale", F.unix_timestamp(now) - F.unix_timestamp("created_at") > hours * 3600)
