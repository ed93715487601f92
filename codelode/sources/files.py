"""Source files as a table, and the tables of an index on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of, matches_ignore

IGNORED = [".git/", "node_modules/", "__pycache__/", ".venv/", "venv/", "dist/", "build/", "target/", ".tox/", ".mypy_cache/", ".pytest_cache/", "*.egg-info/", "vendor/"]
MOST_BYTES = 10_000_000


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, ignored: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, language, size_bytes, content) of the files under a folder that are in a known language, not ignored and not too large; bytes are read only of those. Empty files give no row."""
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", f"^(?:file:)?/*{base.lstrip('/')}/", "")
    f = f.where(F.col("length") <= most_bytes).select(path.alias("path"), F.col("length").alias("size_bytes"), "content")
    f = f.where(language_of(F.col("path")).isNotNull() & ~matches_ignore(F.col("path"), IGNORED if ignored is None else ignored)).withColumn("language", language_of(F.col("path")))
    return f.where(F.col("language").isin(languages)) if languages else f


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of equal key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_files(table: DataFrame, paths: DataFrame, columns: list[str]) -> DataFrame:
    """table without rows that have one of paths (path) in any of the columns."""
    out = table
    for c in columns:
        out = out.join(paths.select(F.col("path").alias(c)).distinct(), c, "left_anti")
    return out.select(table.columns)


def save(table: DataFrame, folder: str, name: str) -> None:
    table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def cache_key(identity: F.Column, commit: F.Column) -> F.Column:
    """SHA-256 of the identity, with @commit if there is one."""
    return F.sha2(F.concat(identity, F.coalesce(F.concat(F.lit("@"), commit), F.lit(""))), 256)
