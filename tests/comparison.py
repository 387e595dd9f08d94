"""A query's rows against its DuckDB SQL, regardless of order."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def rows_of_spark(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(repr(tuple(plain(r[k]) for k in at)) for r in found.fetchall())
