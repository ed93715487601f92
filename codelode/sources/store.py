"""An index kept in a folder as versions of its tables, and a cache of such folders by key.

Every change writes a new version beside the last one and then moves one small pointer file into place, so readers see the old
tables or the new ones, and a job that fails in between leaves the old ones current. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import delete_files, upsert

SCHEMA_VERSION = "1"
_FLAG = "needs_reindex"


class _Files:
    """The few calls on a file system that Spark does not have; any that Hadoop knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        s = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def write(self, name: str, text: str) -> None:
        """All of the file or none of it."""
        s = self.fs.create(self.path(name + ".new"), True)
        s.write(bytearray(text.encode()))
        s.close()
        if self.fs.exists(self.path(name)):
            self.fs.delete(self.path(name), False)
        if not self.fs.rename(self.path(name + ".new"), self.path(name)):
            raise OSError(f"could not move {name} into place")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def folders(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name)) if x.isDirectory()) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()


class Store:
    """Tables by name in one folder; all reads are of the version that was current when the table was asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark, folder)

    def _state(self) -> dict:
        """Where each table is, and the metadata. A pointer that was being replaced when its writer ended is found under its new name."""
        for name in (f"{self.folder}/current.json", f"{self.folder}/current.json.new"):
            if self.files.exists(name):
                return json.loads(self.files.read(name))
        return {"tables": {}, "metadata": {}}

    def write(self, metadata: dict[str, str] | None = None, **tables: DataFrame) -> None:
        """Replaces the tables given, and the metadata's given keys, all at once."""
        state = self._state()
        old = []
        for name, df in tables.items():
            place = f"{name}-{time.time_ns()}"
            df.write.parquet(f"{self.folder}/{place}")
            old.append(state["tables"].get(name))
            state["tables"][name] = place
        state["metadata"] |= metadata or {}
        self.files.write(f"{self.folder}/current.json", json.dumps(state))
        for place in filter(None, old):
            self.files.delete(f"{self.folder}/{place}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._state()['tables'][name]}")

    def has(self, name: str) -> bool:
        return name in self._state()["tables"]

    def lookup(self, name: str, column: str, wanted: DataFrame | list) -> DataFrame:
        """Rows whose column is one of a list (pushed to the scan), or of the first column of a table, of any size; repeated keys count once."""
        if isinstance(wanted, DataFrame):
            return self.table(name).join(wanted.toDF(column, *wanted.columns[1:]).select(column).distinct(), column, "left_semi")
        return self.table(name).where(F.col(column).isin(list(wanted)))

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        self.write(**{name: upsert(self.table(name), rows, key) if self.has(name) else rows})

    def append(self, name: str, rows: DataFrame) -> None:
        """Duplicates are kept."""
        self.write(**{name: self.table(name).unionByName(rows) if self.has(name) else rows})

    def replace_files(self, paths: DataFrame, chunks: DataFrame, edges: DataFrame, surrogates: DataFrame | None = None) -> None:
        """Takes out all rows of the files (path) and puts the new ones in, of all tables at once; edges go that touch one of the files at either end."""
        new = {"chunks": (chunks, ["file_path"]), "edges": (edges, ["source", "target"])}
        if surrogates is not None:
            new["surrogates"] = (surrogates, ["file_path"])
        self.write(**{name: delete_files(self.table(name), paths, columns).unionByName(rows) for name, (rows, columns) in new.items()})

    def get_metadata(self, key: str) -> str | None:
        return self._state()["metadata"].get(key)

    def set_metadata(self, key: str, value: str) -> None:
        self.write({key: value})

    def needs_reindex(self) -> bool:
        return self.get_metadata(_FLAG) == "true"

    def clear_reindex(self) -> None:
        self.set_metadata(_FLAG, "false")

    def migrate(self, defaults: dict[str, dict[str, str]]) -> None:
        """Brings tables of an older schema up to date: missing columns come as null of the type given, and the index is marked for a rebuild."""
        if self.get_metadata("schema_version") == SCHEMA_VERSION:
            return
        new = {}
        for name, columns in defaults.items():
            if self.has(name) and (missing := {c: t for c, t in columns.items() if c not in self.table(name).columns}):
                new[name] = self.table(name).withColumns({c: F.lit(None).cast(t) for c, t in missing.items()})
        self.write({"schema_version": SCHEMA_VERSION} | ({_FLAG: "true"} if new else {}), **new)

    def save_vectors(self, name: str, vectors: DataFrame, **facts: str) -> None:
        """vectors with facts (embedder, dimension, mode, version ...) that a reader has to agree with, and their number."""
        self.write({f"{name}.facts": json.dumps({k: str(v) for k, v in sorted(facts.items())}), f"{name}.rows": str(vectors.count())}, **{name: vectors})

    def load_vectors(self, name: str, chunks: DataFrame | None = None, **facts: str) -> DataFrame:
        """Raises ValueError where a fact given differs from the saved one, or chunks are not as many as the vectors."""
        saved = json.loads(self.get_metadata(f"{name}.facts") or "{}")
        wrong = {k: (saved.get(k), str(v)) for k, v in facts.items() if saved.get(k) != str(v)}
        if wrong:
            raise ValueError(f"{name}: saved and expected differ: {wrong}")
        if chunks is not None and chunks.count() != int(self.get_metadata(f"{name}.rows") or -1):
            raise ValueError(f"{name}: not as many vectors as chunks")
        return self.table(name)


class Cache:
    """Stores by key, each with a note of when and from what it was made."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark, folder)

    def _at(self, key: str) -> str:
        if not re.fullmatch(r"[0-9a-f]{64}", key):
            raise ValueError(f"not a key: {key!r}")
        return f"{self.folder}/{key}"

    def put(self, key: str, now: float | None = None, commit: str | None = None, identity: str | None = None, **tables: DataFrame) -> Store:
        store = Store(self.spark, self._at(key))
        facts = {"created_at": str(time.time() if now is None else now), "commit": commit, "identity": identity}
        store.write({k: v for k, v in facts.items() if v is not None}, **tables)
        return store

    def get(self, key: str) -> Store | None:
        return Store(self.spark, self._at(key)) if self.files.exists(f"{self._at(key)}/current.json") else None

    def get_meta(self, key: str) -> dict[str, str]:
        store = self.get(key)
        return store._state()["metadata"] if store else {}

    def is_stale(self, key: str, hours: float = 24, now: float | None = None) -> bool:
        """What has no time of making is stale."""
        made = self.get_meta(key).get("created_at")
        return made is None or (time.time() if now is None else now) - float(made) > hours * 3600

    def invalidate(self, key: str) -> None:
        self.files.delete(self._at(key))

    def list_entries(self) -> DataFrame:
        """(key, created_at, commit, identity, bytes), one row an entry."""
        rows = []
        for key in self.files.folders(self.folder):
            m = self.get_meta(key)
            rows.append((key, float(m.get("created_at", 0)), m.get("commit"), m.get("identity"), self.files.size(f"{self.folder}/{key}")))
        return self.spark.createDataFrame(rows, "key string, created_at double, commit string, identity string, bytes long")

    def clean(self, hours: float = 24, now: float | None = None) -> int:
        """Deletes stale entries; how many."""
        old = [k for k in self.files.folders(self.folder) if self.is_stale(k, hours, now)]
        for k in old:
            self.invalidate(k)
        return len(old)

    def info(self) -> DataFrame:
        """(entries, bytes)."""
        return self.list_entries().agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))

    def find(self, identity: str) -> tuple[Store, str | None] | None:
        """The latest store of a source at any commit, with its commit."""
        of = self.list_entries().where(F.col("identity") == identity).orderBy(F.col("created_at").desc(), "key").first()
        return (Store(self.spark, self._at(of["key"])), of["commit"]) if of else None


def name_status(line: F.Column) -> F.Column:
    """A line of `git diff --name-status` as struct(status, path, old_path): M, A and D with a path, R and a score with both; null for any other line."""
    p = F.split(line, "\t")
    plain = p[0].isin("M", "A", "D") & (F.size(p) == 2)
    moved = p[0].rlike("^R[0-9]*$") & (F.size(p) == 3)
    return F.when(plain, F.struct(p[0].alias("status"), F.try_element_at(p, F.lit(2)).alias("path"), F.lit(None).cast("string").alias("old_path"))).when(
        moved, F.struct(F.lit("R").alias("status"), F.try_element_at(p, F.lit(3)).alias("path"), F.try_element_at(p, F.lit(2)).alias("old_path")))
