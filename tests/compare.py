"""Comparing a query with its SQL, by DuckDB, as sets of rows whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return round(value, 9)
    return int(value) if isinstance(value, int) else str(value)


def duck_rows(sql, folder=SF):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(path := f"{folder}/{name}.parquet"):
            con.execute(f"create view {name} as select * from '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def same_rows(frame, sql, folder=SF):
    names, expected = duck_rows(sql, folder)
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = sorted((tuple(plain(row[i]) for i in at) for row in expected), key=repr)
    got = sorted((tuple(plain(v) for v in row) for row in frame.select(*order).collect()), key=repr)
    assert got == want
    return len(got)
