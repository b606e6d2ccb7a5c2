import uuid
from contextlib import closing

import pytest
from colloquy.sources import database as D
from colloquy.sources import files
from colloquy.sources.files import store
from colloquy.sources.schemas import USERS


@pytest.mark.parametrize(
    "address,expected",
    [
        ("postgresql+psycopg://me:p%40ss@db.example:5433/chat?sslmode=require", {"url": "jdbc:postgresql://db.example:5433/chat", "driver": "org.postgresql.Driver", "sslmode": "require", "user": "me", "password": "p@ss"}),
        ("mysql+pymysql://db/chat", {"url": "jdbc:mysql://db/chat", "driver": "com.mysql.cj.jdbc.Driver"}),
        ("sqlite:///./chat.db", {"url": "jdbc:sqlite:./chat.db", "driver": "org.sqlite.JDBC"}),
        ("sqlite:////data/chat.db", {"url": "jdbc:sqlite:/data/chat.db", "driver": "org.sqlite.JDBC"}),
        ("mssql://sa:x@h/chat", {"url": "jdbc:sqlserver://h:1433;databaseName=chat", "driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "user": "sa", "password": "x"}),
        ("jdbc:postgresql://h/chat", {"url": "jdbc:postgresql://h/chat", "driver": "org.postgresql.Driver"}),
        ("jdbc:other://h/chat", {"url": "jdbc:other://h/chat"}),
    ],
)
def test_addresses(address, expected):
    assert D.jdbc_options(address) == expected


def test_unknown_dialect():
    with pytest.raises(ValueError):
        D.jdbc_options("oddbase://h/x")


def stored(spark, rows, schema):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    spark.createDataFrame(rows, schema).coalesce(1).write.jdbc(url, "items", properties=D.jdbc_options(url))
    return url


KEYS = ['"k"', '"id"']


def test_skewed_key_has_no_empty_or_overfull_part(spark):
    rows = [(7 if i % 2 else None if i % 40 == 0 else i * i * 1000 - 5 if i % 3 else -(10**9) + i, i) for i in range(3000)]
    url = stored(spark, rows, "k long, id long")
    frame = D.database_table(spark, url, "items", KEYS, rows=100)
    sizes = [len(p) for p in frame.rdd.glom().collect()]
    assert sum(sizes) == 3000 and min(sizes) >= 1 and max(sizes) <= 100 and len(sizes) <= 75
    assert {tuple(r) for r in frame.collect()} == set(rows)
    counted = D.Histogram(spark, D.jdbc_options(url), "items", KEYS, 100).parts()
    assert sorted(p.rows for p in counted) == sorted(sizes)
    whole = D.Histogram(spark, D.jdbc_options(url), "items", KEYS[:1], 100).parts()  # one value that no other key cuts
    assert max(p.rows for p in whole) == 1500 and sum(p.rows for p in whole) == 3000


def test_filters_reach_the_database(spark):
    url = stored(spark, [(i % 5, i) for i in range(50)], "k long, id long")
    frame = D.database_table(spark, url, "items", KEYS, rows=10).where("id > 47").select("id")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,47)]" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert {r.id for r in frame.collect()} == {48, 49}


def test_empty_table_and_one_connection(spark):
    url = stored(spark, [], "k long, id long")
    assert D.database_table(spark, url, "items", KEYS).count() == 0
    assert D.database_table(spark, url, "items").columns == ["k", "id"]


def test_schema_of_a_stored_table(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    from datetime import datetime

    rows = [("1", "a@b.org", "h", True, False, True, datetime(2026, 1, 2))]
    spark.createDataFrame(rows, USERS).write.jdbc(url, "users", properties=D.jdbc_options(url))
    assert [tuple(r) for r in D.database_table(spark, url, "users").collect()] == rows


def test_files_are_read_in_parts_by_processes_of_their_own(spark, tmp_path):
    """The database is no one's memory: Python workers, as on any executor, read what another task stored."""
    rows = [(7 if i % 2 else None if i % 40 == 0 else i, i, f"é'{i}" if i % 9 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k long, id long, name string")
    address = f"file://{tmp_path}/a b.db"
    store(frame, address, "items", ["k", "id"])
    got = D.database_file_table(spark, address, "items", frame.schema, ["k", "id"], rows=100)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert sum(sizes) == 3000 and min(sizes) >= 1 and max(sizes) <= 100 and len(sizes) <= 75
    assert {tuple(r) for r in got.collect()} == set(rows)
    store(frame.limit(0), f"{address}2", "items", ["k", "id"])
    assert D.database_file_table(spark, f"{address}2", "items", frame.schema, ["k", "id"]).count() == 0


def test_many_parts_are_few_tasks_and_each_is_one_stretch_of_the_index(spark, tmp_path):
    """Two thirds are of one value, as in the query: its parts must not search all that value's rows, and tasks must not grow with parts."""
    rows = [(0 if i % 3 else i % 40, i) for i in range(12_000)] + [(None, i) for i in range(300)] + [(-(2**63), 2**63 - 1), (2**63 - 1, -(2**63)), (5, None)]
    frame = spark.createDataFrame(rows, "k long, id long")
    address = f"file://{tmp_path}/many.db"
    store(frame, address, "items", ["k", "id"])
    got = D.database_file_table(spark, address, "items", frame.schema, ["k", "id"], rows=10)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert len(sizes) <= 64 and min(sizes) > 0 and max(sizes) < 400
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    with closing(files.opened(f"{tmp_path}/many.db")) as base:
        found = list(files.parts(base, "items", ["k", "id"], 10))
        counts = [base.execute(f"SELECT COUNT(*) FROM items WHERE {p}").fetchone()[0] for p in found]
        assert sum(counts) == len(rows) and min(counts) > 0 and max(counts) <= 10 and len(counts) < 2 * len(rows) / 10
        for p in found:
            [(*_, plan)] = base.execute(f"EXPLAIN QUERY PLAN SELECT * FROM items WHERE {p}").fetchall()
            assert plan.startswith("SEARCH") and ("id" not in p or "(k=? AND id" in plan)


def test_a_store_without_rows_or_with_one_full_value(spark, tmp_path):
    """A value that no other key cuts stays whole, and neighbours are not lost beside it; nulls alone are read as well."""
    for n, rows in enumerate([[], [(None, 1)] * 30, [(3, i) for i in range(30)], [(2, 0)] * 3 + [(3, i) for i in range(30)] + [(4, 0)] * 3]):
        frame = spark.createDataFrame(rows, "k long, id long")
        address = f"file://{tmp_path}/full{n}.db"
        store(frame, address, "items", ["k"])
        got = D.database_file_table(spark, address, "items", frame.schema, ["k"], rows=10)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))


def test_query_does_not_use_memory_of_the_driver(spark):
    from colloquy import registry
    from compare import SF

    plan = registry.queries()["database_read"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "JDBC" not in plan
