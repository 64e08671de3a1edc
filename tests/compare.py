"""Hold a query against its SQL in DuckDB over the driver's tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that sorts and compares alike from both engines; floats to nine digits."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf: str) -> str:
    """What differs, or nothing."""
    found = query(spark, sf)
    want = tables(sf).execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)}, SQL has {sorted(names)}"
    a, b = rows_of(found.columns, found.collect()), rows_of(names, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}"
    if a and [type(x) for x in a[0] if x is not None] != [type(x) for x in b[0] if x is not None]:
        return f"types differ: {a[0]}, SQL has {b[0]}"
    unlike = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not close(x, y)]
    return f"{len(unlike)} of {len(a)} rows, first {unlike[0]}" if unlike else ""


def close(x, y) -> bool:
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(map(close, x, y))
    return x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)
