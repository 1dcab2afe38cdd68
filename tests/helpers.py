"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def _cell(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(_cell, value))
    return value


def rows_of(df) -> list:
    columns = sorted(df.columns)
    return sorted((repr(tuple(map(_cell, r))) for r in df.select(*columns).collect()))


def sql_rows(sql: str, folder: str = SMALL, **tables) -> list:
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    for name, frame in tables.items():
        con.register("_" + name, frame)
        con.execute(f"CREATE OR REPLACE TABLE {name}_t AS SELECT * FROM _{name}")
        con.execute(f"DROP VIEW {name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_t")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(_cell(r[i]) for i in order)) for r in cursor.fetchall())
