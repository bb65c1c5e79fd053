"""Order-insensitive comparison of a Spark result with a DuckDB statement."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(
        plain, key=lambda r: tuple((v is not None, type(v).__name__, v) for v in r))


def difference(frame, con, sql: str) -> str | None:
    """None when both sides agree on names, rows and values, else what differs."""
    cursor = con.execute(sql)
    wide = [c[0] for c in cursor.description if str(c[1]).startswith(("HUGEINT", "DECIMAL"))]
    if wide:
        return f"statement leaves non-portable types in {wide}"
    d_cols, d_rows = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    s_cols, s_rows = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}"
    if len(s_rows) != len(d_rows):
        return f"{len(s_rows)} rows != {len(d_rows)}"
    for left, right in zip(s_rows, d_rows):
        for name, a, b in zip(s_cols, left, right):
            if isinstance(a, float) and isinstance(b, float):
                if a != b and not math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9):
                    return f"{name}: {a!r} != {b!r} in {left} / {right}"
            elif a != b or type(a) is not type(b):
                return f"{name}: {a!r} != {b!r} in {left} / {right}"
    return None
