"""Order-insensitive comparison of a Spark result with the SQL counterpart in DuckDB."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "array<float>": "FLOAT[]",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, datetime.datetime | datetime.date):
        return (2, value.isoformat())
    return (3, str(value))


def difference(df, con, sql: str) -> str | None:
    """None if names, types and rows agree, else what does not."""
    relation = con.execute(sql)
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    theirs = {d[0]: str(d[1]) for d in relation.description}
    rows_theirs = relation.fetchall()
    if ours != theirs:
        return f"schema {ours} != {theirs}"
    names = sorted(ours)
    place = {name: i for i, name in enumerate(theirs)}
    left = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    right = sorted(tuple(_plain(r[place[n]]) for n in names) for r in rows_theirs)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            odd = [(n, x[1][:200], y[1][:200]) for n, x, y in zip(names, a, b) if x != y]
            return f"first difference {odd} in {a}"[:1500]
    return None
