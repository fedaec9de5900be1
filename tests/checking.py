"""Compare a registered query with its check SQL, cell by cell."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(columns, data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    found_columns, found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    wanted_columns, wanted = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if found_columns != wanted_columns:
        return f"columns {found_columns} != {wanted_columns}"
    if len(found) != len(wanted):
        return f"{len(found)} rows != {len(wanted)}"
    for a, b in zip(found, wanted):
        if a != b:
            return f"{found_columns}: {a} != {b}"
    return None
