"""Compares queries with their DuckDB SQL, as sets of rows with columns by name."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value in a form that both engines share."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(repr(x)) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (date, datetime)):
        return str(x)
    return x


def duck(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(x.asDict(True) if hasattr(x, "asDict") else x) for x in r) for r in df.select(*names).collect())


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    (a, x), (b, y) = spark_rows(df), duck(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        more, less = x - y, y - x
        return f"{x.total()} and {y.total()} rows; only Spark: {sum(more.values())} {list(more)[:2]}; only SQL: {sum(less.values())} {list(less)[:2]}"
    return ""
