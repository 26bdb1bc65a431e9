"""Registered queries against their SQL, both run over the same tables."""

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    return None if v is None else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((c is not None, c or "") for c in r))


def differences(df, con, sql: str) -> str | None:
    """What differs between a Spark result and the result of its SQL; None if nothing does."""
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    expected = _rows(columns, found.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows / {len(expected)}: {got[:2]} / {expected[:2]}"
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}" if wrong else None
