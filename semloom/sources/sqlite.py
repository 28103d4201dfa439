"""SQLite tables as a Spark data source, read in ranges of an integer key. Without a JDBC driver; the file must be where executors can open it."""

from __future__ import annotations

import os
import sqlite3
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string", "": "string"}


def is_sqlite(path: str) -> bool:
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        return f.read(16) == b"SQLite format 3\0"


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """Options: path, table, key (an integer column), partitions; after and until: only keys above and up to these are read; columns: only
    these, by name, with commas between them."""

    @classmethod
    def name(cls) -> str:
        return "semloom_sqlite"

    def schema(self) -> str:
        db = _open(self.options["path"])
        try:
            columns = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        finally:
            db.close()
        if not columns:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        if "columns" in self.options:
            columns = [c for c in columns if c[1] in self.options["columns"].split(",")]
        return ", ".join(f"`{c[1]}` {_KINDS.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(dict(self.options), [f.name for f in schema.fields])


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[InputPartition]:
        key, table = _name(self.options["key"]), _name(self.options["table"])
        db = _open(self.options["path"])
        try:
            low, high = db.execute(f"SELECT MIN({key}), MAX({key}) FROM {table}").fetchone()
        finally:
            db.close()
        if low is None:
            return [Range(0, 0)]
        low, high = max(low, int(self.options.get("after", low - 1)) + 1), min(high, int(self.options.get("until", high)))
        if low > high:
            return [Range(0, 0)]
        n = min(int(self.options.get("partitions", 8)), high - low + 1)
        cuts = [low + (high - low + 1) * i // n for i in range(n + 1)]
        return [Range(a, b) for a, b in zip(cuts[:-1], cuts[1:])]

    def read(self, part: Range):
        key, table = _name(self.options["key"]), _name(self.options["table"])
        db = _open(self.options["path"])
        try:
            yield from map(tuple, db.execute(f"SELECT {', '.join(map(_name, self.columns))} FROM {table} WHERE {key} >= ? AND {key} < ? ORDER BY {key}", (part.low, part.high)))
        finally:
            db.close()


def read_sqlite(spark: SparkSession, path: str, table: str, key: str, partitions: int = 8, after: int | None = None, until: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of a table with after < key <= until, by its index, and of them only ``columns`` (those of them that it has)."""
    spark.dataSource.register(SqliteSource)
    bounds = {k: v for k, v in (("after", after), ("until", until), ("columns", columns and ",".join(columns))) if v is not None}
    return spark.read.format("semloom_sqlite").options(path=os.path.abspath(path), table=table, key=key, partitions=partitions, **bounds).load()


def highest(path: str, table: str, key: str) -> int:
    """The largest key, by one step in its index; 0 for an empty table."""
    db = _open(path)
    try:
        return db.execute(f"SELECT MAX({_name(key)}) FROM {_name(table)}").fetchone()[0] or 0
    finally:
        db.close()
