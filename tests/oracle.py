"""Hold a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v, digits):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x, digits)) for k, x in v.items()))
    if isinstance(v, (float, Decimal)):
        v = round(float(v), digits)
        return v + 0.0
    return v


def rows_of(columns, records, digits):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k], digits) for k in order) for r in records), key=repr)


def differences(df, con, sql: str, digits: int = 9) -> str | None:
    got = rows_of(df.columns, df.collect(), digits)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall(), digits)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; only here {sorted(set(got) - set(want), key=repr)[:2]}, only there {sorted(set(want) - set(got), key=repr)[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b) and a != b]
    return f"{len(bad)} of {len(got)} rows differ, say {bad[0]}" if bad else None
