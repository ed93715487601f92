"""Tables in the folder that all executors share: a computed table is written once and read again, which cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset (tests, one machine) a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/codelode"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="codelode-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer partitions than there are cores; larger inputs are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b), by alternating star contraction.

    Nodes of no edge are absent. Every round is written to the shared folder; rounds grow with the logarithm of the
    longest path.
    """
    e = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
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
