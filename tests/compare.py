"""Spark results beside DuckDB's on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _row(values):
    return tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in values)


def same(df, con, sql: str) -> None:
    """Equal columns and equal rows, in any order."""
    names = sorted(df.columns)
    rows = sorted((_row(r) for r in df.select(*names).collect()), key=repr)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    wanted = sorted((_row(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert len(rows) == len(wanted)
    assert rows == wanted
