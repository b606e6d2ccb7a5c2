"""Tables of an embedded database in a file (SQLite), by Python's own driver, as a data source: ``format("sqlitefile")``.

An embedded database in memory is one process's own, so executors do not see what the driver stored there. A
file in the folder that all share is: every task opens it itself, for reading only. One task writes a file, and
it gets its name when it is complete.

A table is read in parts that follow its index: a part ends before the value that is so many rows further on, and
a value that is too full by itself is cut by the next key column. So finding the parts is one pass over the
index, each part is one stretch of it, and a task reads several parts, one after the other, if there are many.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows that are taken at a time, and tasks up to which each part has its own.
FETCHED, TASKS = 10_000, 64


def local_path(address: str) -> str:
    """A file's path; files of other systems can't be opened by an embedded database."""
    parts = urlsplit(address)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a file: {address}")
    return unquote(parts.path) if parts.scheme else address


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)


def store(frame: DataFrame, address: str, name: str, keys: list[str]) -> None:
    """The rows of a frame (numbers and texts) as a table of a new file, with an index of its keys."""
    path, columns, places = local_path(address), ", ".join(quoted(c) for c in frame.columns), ", ".join("?" * len(frame.columns))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = f"{path}.{uuid.uuid4().hex}"
        with closing(sqlite3.connect(made)) as base:
            base.execute(f"CREATE TABLE {quoted(name)} ({columns})")
            for batch in batches:
                base.executemany(f"INSERT INTO {quoted(name)} VALUES ({places})", zip(*(column.to_pylist() for column in batch.columns)))
            base.execute(f"CREATE INDEX {quoted(name + '_keys')} ON {quoted(name)} ({', '.join(quoted(k) for k in keys)})")
            base.commit()
        os.replace(made, path)
        yield pa.RecordBatch.from_pydict({"stored": [True]})

    if not frame.repartition(1).mapInArrow(write, "stored boolean").collect():  # no rows, so maybe no task
        list(write(iter(())))


def parts(base: sqlite3.Connection, table: str, keys: list[str], rows: int) -> Iterator[str]:
    """Predicates of parts of at most so many rows, none of them empty; only a value that no further key cuts is left whole."""

    def value(key: str, where: str, skipped: int = 0) -> int | None:
        found = base.execute(f"SELECT {key} FROM {table} WHERE {where} ORDER BY {key} LIMIT 1 OFFSET {skipped}").fetchone()
        return found and found[0]

    def cut(where: str, level: int) -> Iterator[str]:
        if level == len(keys) or not base.execute(f"SELECT 1 FROM {table} WHERE {where} LIMIT 1 OFFSET {rows}").fetchone():
            yield where
            return
        key = keys[level]
        null = f"{where} AND {key} IS NULL"
        if base.execute(f"SELECT 1 FROM {table} WHERE {null} LIMIT 1").fetchone():
            yield from cut(null, level + 1)
        low = value(key, f"{where} AND {key} IS NOT NULL")
        while low is not None:
            own = f"{where} AND {key} >= {low}"
            high = value(key, own, rows)
            if high == low:  # by equality the index leads on to the next key, by a range it does not
                yield from cut(f"{where} AND {key} = {low}", level + 1)
                low = value(key, f"{where} AND {key} > {low}")
            else:
                yield own if high is None else f"{own} AND {key} < {high}"
                low = high

    return cut("1 = 1", 0)


class Parts(InputPartition):
    def __init__(self, predicates: list[str]) -> None:
        self.predicates = predicates


class FileReader(DataSourceReader):
    """Every task gets this reader, so it holds no parts; they are found where the scan is planned."""

    def __init__(self, path: str, table: str, columns: list[str], keys: list[str], rows: int, tasks: int) -> None:
        self.path, self.table, self.columns, self.keys, self.rows, self.tasks = path, quoted(table), columns, [quoted(k) for k in keys], rows, tasks

    def partitions(self) -> list[Parts]:
        with closing(opened(self.path)) as base:
            found = list(parts(base, self.table, self.keys, self.rows))
        n = min(self.tasks, len(found))
        return [Parts(found[len(found) * i // n : len(found) * (i + 1) // n]) for i in range(n)]

    def read(self, partition: Parts) -> Iterator[tuple]:
        with closing(opened(self.path)) as base:
            for predicate in partition.predicates:
                found = base.execute(f"SELECT {', '.join(quoted(c) for c in self.columns)} FROM {self.table} WHERE {predicate}")
                while rows := found.fetchmany(FETCHED):
                    yield from rows


class SqliteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlitefile"

    def reader(self, schema: T.StructType) -> FileReader:
        given = self.options
        return FileReader(given["path"], given["table"], schema.fieldNames(), json.loads(given["keys"]), int(given["rows"]), int(given["tasks"]))


def file_table(spark: SparkSession, address: str, name: str, schema: T.StructType, keys: list[str], rows: int) -> DataFrame:
    """A table of such a file, read by all executors in parts of at most so many rows, by the keys that it has an index of."""
    spark.dataSource.register(SqliteFile)
    tasks = max(TASKS, 4 * spark.sparkContext.defaultParallelism)
    return spark.read.format("sqlitefile").schema(schema).options(path=local_path(address), table=name, keys=json.dumps(keys), rows=rows, tasks=tasks).load()
