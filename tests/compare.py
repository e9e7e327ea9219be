"""Order-insensitive comparison of a Spark result with SQL run by DuckDB."""

from __future__ import annotations

import decimal
from collections import Counter

import duckdb

from tests.conftest import RAW_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        raise AssertionError("decimal in a result; cast it to double")
    return value


def mismatch(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when columns and rows agree, otherwise what differs."""
    names = sorted(df.columns)
    got = Counter(tuple(_plain(v) for v in row) for row in df.select(*names).collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    order = [columns.index(n) for n in names]
    want = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    if got == want:
        return ""
    return f"rows {sum(got.values())} != {sum(want.values())}; only here {list((got - want).items())[:3]}; " \
           f"only there {list((want - got).items())[:3]}"
