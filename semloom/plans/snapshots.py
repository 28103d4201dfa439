"""Versioned tables in a folder: each commit is a new folder, and a manifest names the current ones of each table: a whole one, and those
that were added to it since.

A commit writes its tables first and the manifest last, by renaming; a writer that dies leaves the former state. Readers see the version
whose manifest they opened. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Additions to a table that are kept apart at most.
MOST = 24


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm
        self._fs.mkdirs(self._path(self.root))

    def manifest(self) -> dict:
        """{"version", "tables": {name: folder}, "meta": {}} of the newest commit."""
        newest = max((int(s.getPath().getName()[9:-5]) for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("manifest-") and s.getPath().getName().endswith(".json")), default=0)
        if not newest:
            return {"version": 0, "tables": {}, "meta": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest-{newest}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def folders(self, name: str) -> list[str]:
        """Where a table is now; other folders after each change of it."""
        return self.manifest()["tables"].get(name, [])

    def read(self, name: str) -> DataFrame | None:
        folders = self.folders(name)
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def commit(self, tables: dict[str, DataFrame | None], meta: dict | None = None, check=None, more: dict[str, DataFrame] | None = None) -> dict:
        """Write ``tables``, have ``check`` look at what was written (it raises to refuse), then make them current with ``meta`` added.

        ``more`` is added to its tables and nothing of them is written again; after MOST additions such a table is put together. A table that
        is None is left out from now on."""
        now = self.manifest()
        version, after = now["version"] + 1, dict(now["tables"])

        def written(name: str, df: DataFrame) -> str:
            folder = f"{name}/v{version}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.root}/{folder}")
            return folder

        for name, df in tables.items():
            after.pop(name, None)
            if df is not None:
                after[name] = [written(name, df)]
        for name, df in (more or {}).items():
            before = after.get(name, [])
            if len(before) >= MOST:
                df, before = self.spark.read.parquet(*[f"{self.root}/{f}" for f in before]).unionByName(df), []
            after[name] = [*before, written(name, df)]
        if check is not None:
            check({n: self.spark.read.parquet(f"{self.root}/{after[n][0]}") for n in tables if n in after})
        new = {"version": version, "tables": after, "meta": now["meta"] | (meta or {})}
        staged, final = self._path(f"{self.root}/.staged-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{version}.json")
        stream = self._fs.create(staged, False)
        try:
            stream.write(bytearray(json.dumps(new, sort_keys=True).encode()))
            stream.hsync()
        finally:
            stream.close()
        if not self._fs.rename(staged, final):
            raise RuntimeError(f"version {version} was committed by another writer")
        return new

    @contextmanager
    def staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df``, written once for a while: it is the same each time it is read."""
        folder = f"{self.root}/.rows-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        try:
            yield self.spark.read.schema(df.schema).parquet(folder)
        finally:
            self._fs.delete(self._path(folder), True)

    def set_meta(self, key: str, value) -> None:
        self.commit({}, {key: value})

    def get_meta(self, key: str, default=None):
        return self.manifest()["meta"].get(key, default)

    def vacuum(self, keep: int = 2) -> None:
        """Remove the manifests and tables that only versions before the last ``keep`` name."""
        versions = sorted(int(s.getPath().getName()[9:-5]) for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("manifest-"))
        kept: set[str] = set()
        named: set[str] = set()
        for v in versions:
            stream = self._fs.open(self._path(f"{self.root}/manifest-{v}.json"))
            tables = {f for t in json.loads(bytes(stream.readAllBytes()))["tables"].values() for f in t}
            stream.close()
            (kept if v in versions[-keep:] else named).update(tables)
            if v not in versions[-keep:]:
                self._fs.delete(self._path(f"{self.root}/manifest-{v}.json"), False)
        for folder in named - kept:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
