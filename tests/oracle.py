"""Compares a query with its DuckDB SQL: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def compare(df, sql: str, sf_dir: str) -> None:
    want = duck(sf_dir).sql(sql)
    names, expected = rows_of(want.columns, want.fetchall())
    got_names, got = rows_of(df.columns, df.collect())
    assert got_names == names
    assert len(got) == len(expected), (len(got), len(expected))
    different = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    assert not different, different[:3]
