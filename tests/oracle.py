"""Comparison of a query with its SQL in DuckDB over the same Parquet files."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def _plain(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def from_duckdb(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = db.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def rows(names: list[str], values: list) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(_plain(v[i]) for i in order)) for v in values)


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, values = from_duckdb(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, values)
