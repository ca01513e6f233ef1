"""Databases by Python's DB-API as a Spark data source: queries read in ranges, rows inserted, replaced or deleted by key.

A write is staged: each task puts its rows into a staging table under its partition and attempt, and the commit moves the
rows of the attempts that succeeded into the table by a few statements in one transaction, which also notes the write's
name. A task that runs again, an attempt that dies half way and a commit that is repeated leave every row once. Rows pass
from tasks to the database only, never through the driver.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LEDGER = "spark_writes"


class _Link:
    """A connection's module and arguments, from options module and connect (JSON); quoting and placeholders of its kind."""

    def __init__(self, options: dict) -> None:
        self.module, self.connect = options.get("module", "sqlite3"), json.loads(options["connect"])

    def open(self):
        return importlib.import_module(self.module).connect(**self.connect)

    def marks(self, n: int) -> str:
        style = importlib.import_module(self.module).paramstyle
        return ", ".join({"qmark": "?", "format": "%s", "pyformat": "%s", "numeric": f":{i + 1}"}[style] for i in range(n))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None


class QueryReader(DataSourceReader):
    """Rows of a query; with options column, low, high and parts in so many ranges of an integer column, the first and last
    open and nulls in the first."""

    def __init__(self, options: dict) -> None:
        self.link, self.options = _Link(options), dict(options)

    def partitions(self) -> list[InputPartition]:
        o = self.options
        if "column" not in o:
            return [Range(None, None)]
        low, high, n = int(o["low"]), int(o["high"]), int(o["parts"])
        ends = sorted({low + (high - low) * i // n for i in range(1, n)})
        return [Range(a, b) for a, b in zip([None, *ends], [*ends, None], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        query, tests = f"SELECT * FROM ({self.options['query']}) q", []
        if partition.low is not None:
            tests.append(f"{quoted(self.options['column'])} >= {partition.low}")
        if partition.high is not None:
            tests.append(f"{quoted(self.options['column'])} < {partition.high}")
        if tests:
            query += f" WHERE {' AND '.join(tests)}"
            if partition.low is None:
                query += f" OR {quoted(self.options['column'])} IS NULL"
        c = self.link.open()
        try:
            rows = c.cursor()
            rows.execute(query)
            while some := rows.fetchmany(10_000):
                yield from map(tuple, some)
        finally:
            c.close()


@dataclass
class Staged(WriterCommitMessage):
    part: int
    attempt: int
    rows: int


class StagedWriter(DataSourceWriter):
    """See the module. Options: table, mode (insert, replace or delete), keys (for the last two, JSON), name (of the write: one
    that was committed isn't again)."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.link, self.table, self.mode = _Link(options), options["table"], options.get("mode", "insert")
        self.keys, self.name = json.loads(options.get("keys", "[]")), options.get("name") or uuid.uuid4().hex
        self.columns = [f.name for f in schema.fields]
        if self.mode not in ("insert", "replace", "delete") or self.mode != "insert" and not self.keys:
            raise ValueError("mode is insert, or replace or delete with keys")
        self.stage = f"stage_{uuid.uuid5(uuid.NAMESPACE_OID, self.name).hex}"
        c = self.link.open()  # on the driver, before any task
        try:
            c.cursor().execute(f"CREATE TABLE IF NOT EXISTS {LEDGER} (name VARCHAR(200) PRIMARY KEY, written BIGINT)")
            c.cursor().execute(f"CREATE TABLE IF NOT EXISTS {self.stage} AS SELECT {self._list('t')}, 0 AS _part, 0 AS _attempt FROM {quoted(self.table)} t WHERE 1 = 0")
            c.commit()
        finally:
            c.close()

    def _list(self, of: str = "") -> str:
        return ", ".join(f"{of}.{quoted(c)}" if of else quoted(c) for c in self.columns)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        return self.put(iterator, context.partitionId() if context else 0, context.taskAttemptId() if context else 0)

    def put(self, rows: Iterator, part: int, attempt: int) -> Staged:
        c, n = self.link.open(), 0
        try:
            one = f"INSERT INTO {self.stage} ({self._list()}, _part, _attempt) VALUES ({self.link.marks(len(self.columns) + 2)})"
            some: list = []
            for r in rows:
                some.append((*r, part, attempt))
                n += 1
                if len(some) == 5000:
                    c.cursor().executemany(one, some)
                    some = []
            if some:
                c.cursor().executemany(one, some)
            c.commit()
        finally:
            c.close()
        return Staged(part, attempt, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m is not None]
        c = self.link.open()
        try:
            k = c.cursor()
            k.execute(f"SELECT count(*) FROM {LEDGER} WHERE name = {self.link.marks(1)}", (self.name,))
            if not k.fetchone()[0]:
                k.execute(f"INSERT INTO {LEDGER} (name, written) VALUES ({self.link.marks(2)})", (self.name, sum(m.rows for m in done)))
                good = " OR ".join(f"(_part = {m.part} AND _attempt = {m.attempt})" for m in done) or "1 = 0"
                if self.mode != "insert":
                    k.execute(f"CREATE INDEX {self.stage}_keys ON {self.stage} ({', '.join(map(quoted, self.keys))})")  # else each row of the table reads the whole stage
                    same = " AND ".join(f"s.{quoted(x)} = {quoted(self.table)}.{quoted(x)}" for x in self.keys)
                    k.execute(f"DELETE FROM {quoted(self.table)} WHERE EXISTS (SELECT 1 FROM {self.stage} s WHERE {same} AND ({good}))")
                if self.mode != "delete":
                    k.execute(f"INSERT INTO {quoted(self.table)} ({self._list()}) SELECT {self._list()} FROM {self.stage} WHERE {good}")
            k.execute(f"DROP TABLE IF EXISTS {self.stage}")
            c.commit()
        finally:
            c.close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        c = self.link.open()
        try:
            c.cursor().execute(f"DROP TABLE IF EXISTS {self.stage}")
            c.commit()
        finally:
            c.close()


class Database(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbapi"

    def reader(self, schema: StructType) -> DataSourceReader:
        return QueryReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return StagedWriter(self.options, schema)


def read_query(spark: SparkSession, connect: dict, query: str, schema: str, *, module: str = "sqlite3", column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """Rows of a query of a database, in parts ranges of an integer column if one is given."""
    spark.dataSource.register(Database)
    r = spark.read.format("dbapi").schema(schema).options(module=module, connect=json.dumps(connect), query=query)
    return (r.options(column=column, low=low, high=high, parts=parts) if column else r).load()


def change_rows(df: DataFrame, connect: dict, table: str, mode: str, keys: list[str] | None = None, *, module: str = "sqlite3", name: str | None = None) -> None:
    """Inserts the rows of df, replaces those of equal keys by them, or deletes those of equal keys; all of it or nothing. A
    second write of a name that was committed changes nothing."""
    df.sparkSession.dataSource.register(Database)
    df.write.format("dbapi").mode("append").options(module=module, connect=json.dumps(connect), table=table, mode=mode, keys=json.dumps(keys or []), name=name or uuid.uuid4().hex).save()


def execute(connect: dict, *statements: str, module: str = "sqlite3") -> list[tuple]:
    """Runs statements on the driver, as to make or drop tables; the rows of the last."""
    c = importlib.import_module(module).connect(**connect)
    try:
        k = c.cursor()
        for s in statements:
            k.execute(s)
        rows = k.fetchall() if k.description else []
        c.commit()
        return rows
    finally:
        c.close()
