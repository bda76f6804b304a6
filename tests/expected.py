"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float) and not math.isnan(x):
        return round(x, 6)
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda j: names[j])
    return sorted((tuple(plain(r[j]) for j in order) for r in data), key=repr)


def check(spark, name: str, query, sql: str, sf_dir: str = SF_DIR) -> None:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    con = connect(sf_dir)
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    want = rows(names, answer.fetchall())
    assert sorted(df.columns) == sorted(names), name
    assert len(got) == len(want), name
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6) or (isinstance(b, float) and isinstance(a, int) and a == b), (name, g, w)
