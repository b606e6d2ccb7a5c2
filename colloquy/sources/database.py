"""Reading a database's tables in parts that hold about as many rows each, however skewed the keys are.

The database itself counts rows by ranges of a whole-number key: 64 ranges first, then each range that is
too full again, down to single values; a value that is still too full is cut by the next key column. Each
part becomes a predicate, so its rows are all that its connection reads; filters and columns of the query
are pushed down beside it. What comes to the driver are counts: 64 for each range that was too full.

Defined results: rows whose key is null are a part of their own (cut by the next key column, if there is
one); an empty table is read as one empty part; a value too full with no further key column stays whole.
"""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import file_table
from .schemas import TABLES

#: Schemes of database addresses, their JDBC names and drivers.
DIALECTS = {
    "postgresql": ("postgresql", "org.postgresql.Driver"),
    "postgres": ("postgresql", "org.postgresql.Driver"),
    "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "mariadb": ("mariadb", "org.mariadb.jdbc.Driver"),
    "sqlite": ("sqlite", "org.sqlite.JDBC"),
    "mssql": ("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "derby": ("derby", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),
}
#: Ranges that are counted at a time, and rows of a part.
BINS, ROWS = 64, 1_000_000


def jdbc_options(address: str) -> dict[str, str]:
    """The reader's options for an address: ``scheme+library://user:password@host:port/name?option=value`` or a JDBC URL as it is."""
    if address.startswith("jdbc:"):
        kind = address.split(":", 2)[1]
        driver = next((d for name, d in DIALECTS.values() if name == kind), None)
        return {"url": address} | ({"driver": driver} if driver else {})
    parts = urlsplit(address)
    scheme = parts.scheme.split("+")[0]
    if scheme not in DIALECTS:
        raise ValueError(f"no dialect for {scheme!r}")
    name, driver = DIALECTS[scheme]
    if name in ("sqlite", "derby"):  # a file or a name, three slashes after the scheme; four where it begins with one
        url = f"jdbc:{name}:{parts.path.removeprefix('/') or ':memory:'}"
    elif name == "sqlserver":
        url = f"jdbc:sqlserver://{parts.hostname}:{parts.port or 1433};databaseName={parts.path.lstrip('/')}"
    else:
        host = parts.hostname or "localhost"
        url = f"jdbc:{name}://{f'[{host}]' if ':' in host else host}{f':{parts.port}' if parts.port else ''}{parts.path}"
    out = {"url": url, "driver": driver} | dict(parse_qsl(parts.query))
    if parts.username:
        out["user"] = unquote(parts.username)
    if parts.password:
        out["password"] = unquote(parts.password)
    return out


class Part(NamedTuple):
    predicate: str
    rows: int


class Histogram:
    """Counts of a table's rows by ranges of its keys, made by the database."""

    def __init__(self, spark: SparkSession, options: dict[str, str], table: str, keys: list[str], rows: int) -> None:
        self.spark, self.options, self.table, self.keys, self.rows = spark, options, table, keys, rows

    def ask(self, sql: str) -> list[list]:
        return [list(r) for r in self.spark.read.format("jdbc").options(**self.options, query=sql).load().collect()]

    def parts(self) -> list[Part]:
        n = int(self.ask(f"SELECT COUNT(*) AS n FROM {self.table}")[0][0])
        return self.packed(self.split("1 = 1", n, 0)) or [Part("1 = 1", 0)]

    def split(self, where: str, n: int, level: int) -> list[Part]:
        """Parts of the rows for which a condition holds, by the key of this level."""
        if n <= self.rows or level == len(self.keys):
            return [Part(where, n)] if n else []
        key = self.keys[level]
        low, high, known = self.ask(f"SELECT MIN({key}) AS a, MAX({key}) AS b, COUNT({key}) AS c FROM {self.table} WHERE {where}")[0]
        known = int(known)
        found = self.split(f"{where} AND {key} IS NULL", n - known, level + 1)
        return found + (self.ranges(where, int(low), int(high) + 1, known, level) if known else [])

    def ranges(self, where: str, low: int, high: int, n: int, level: int) -> list[Part]:
        """The same between two values (the second one excluded)."""
        key = self.keys[level]
        own = f"{where} AND {key} >= {low} AND {key} < {high}"
        if n <= self.rows:
            return [Part(own, n)]
        if high - low == 1:
            return self.split(own, n, level + 1)
        width = -(-(high - low) // BINS)
        counts = self.ask(f"SELECT b, COUNT(*) AS n FROM (SELECT FLOOR(({key} - {low}) / {float(width)}) AS b FROM {self.table} WHERE {own}) x GROUP BY b")
        out = []
        for bin_, count in sorted((int(b), int(c)) for b, c in counts):
            begin = low + bin_ * width
            out += self.ranges(where, begin, min(begin + width, high), count, level)
        return self.packed(out)

    def packed(self, parts: list[Part]) -> list[Part]:
        """Neighbours read together as long as they hold no more than a part's rows."""
        out: list[Part] = []
        for part in parts:
            if out and out[-1].rows + part.rows <= self.rows:
                out[-1] = Part(f"{out[-1].predicate} OR {part.predicate}", out[-1].rows + part.rows)
            else:
                out.append(part)
        return [Part(f"({p.predicate})", p.rows) for p in out]


def database_file_table(spark: SparkSession, address: str, name: str, schema: T.StructType, keys: list[str], rows: int = ROWS) -> DataFrame:
    """A table of a file that ``files.store`` wrote, read by all executors in parts of at most so many rows."""
    return file_table(spark, address, name, schema, keys, rows)


def database_table(spark: SparkSession, address: str, name: str, keys: list[str] | None = None, rows: int = ROWS, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A stored table, cast to its schema; with keys (whole numbers, the last one best unique) read in parts of at most so many rows."""
    options = jdbc_options(address) | options
    if keys:
        predicates = [p.predicate for p in Histogram(spark, options, name, keys, rows).parts()]
        frame = spark.read.jdbc(options["url"], name, predicates=predicates, properties={k: v for k, v in options.items() if k != "url"})
    else:
        frame = spark.read.format("jdbc").options(**options, dbtable=name).load()
    schema = schema or TABLES.get(name)
    return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)) if schema else frame
