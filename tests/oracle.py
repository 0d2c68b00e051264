"""Runs a query and its SQL and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_integer_ratio") or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return str(v)


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None. Numbers may differ by one in the last of six digits."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows(names, got.fetchall()), rows(df.columns, df.collect())
    if len(want) != len(have):
        return f"{len(have)} rows, SQL has {len(want)}"
    bad = [(h, w) for h, w in zip(have, want) if not all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1.1e-5 * max(1, abs(b))) for a, b in zip(h, w))]
    return f"{len(bad)} of {len(want)} rows differ: {bad[0]}" if bad else None
