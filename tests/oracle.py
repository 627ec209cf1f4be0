"""Hold queries against their SQL on DuckDB, as the driver does."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def rows(columns: list[str], values: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        return round(x, 6) if isinstance(x, float) else x

    return [columns[k] for k in order], sorted(repr(tuple(plain(r[k]) for k in order)) for r in values)


def compare(con, sql: str, df) -> tuple:
    got = con.execute(sql)
    return rows([x[0] for x in got.description], got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
