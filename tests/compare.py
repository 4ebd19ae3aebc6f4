"""Holds a query's rows against those of its DuckDB SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _sorted(names: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def rows_of_spark(df) -> tuple[list[str], list]:
    return _sorted(df.columns, df.collect())


def rows_of_duckdb(con, sql: str) -> tuple[list[str], list]:
    found = con.execute(sql)
    return _sorted([d[0] for d in found.description], found.fetchall())
