"""A Spark result against a DuckDB result: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    kinds = {x[0]: str(x[1]) for x in got.description}
    assert sorted(df.columns) == sorted(names)
    for c, kind in df.dtypes:
        want = KINDS.get(kinds[c])
        assert want is None or want == kind, (c, kind, kinds[c])
    a, b = rows_of(df.columns, df.collect()), rows_of(names, got.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3], sum(a.values()), sum(b.values()))
