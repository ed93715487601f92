"""What the operators share: column picking, tables in the shared folder, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns by exact name with a type, as name="type". Other columns, however they are called, are left out."""
    cols = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"_{cols.index(n)}").cast(kind).alias(n) for n, kind in names.items()])


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/codelode"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="codelode-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


_SCOPES = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A list of the tables that this thread writes within; at the end all that are still on it are deleted. For work whose result was itself written."""
    written: list[str] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", []), written]
    try:
        yield written
    finally:
        _SCOPES.open = _SCOPES.open[:-1]
        for path in written:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for written in getattr(_SCOPES, "open", []):
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that are read no more; and shuffle files whose results were written go now, not when the driver next happens to collect its garbage."""
    jvm = spark._jvm
    for path in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    jvm.System.gc()


def empty_like(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b), by alternating star contraction.

    Nodes of no edge are absent. Every round is written to the shared folder; rounds grow with the logarithm of the
    longest path.
    """
    spark = edges.sparkSession
    e = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    was = None
    for _ in range(most_rounds):
        # large star: a node's larger neighbours move to its smallest neighbour
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours and the node itself move to the smallest
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        e = materialize(small.where("a <> b").distinct(), "edges")
        row = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        now = (row[0], row[1])
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
