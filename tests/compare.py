"""Compare the named queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (1, "nan") if isinstance(value, float) and math.isnan(value) else (1, repr(float(value)))
    return (1, str(value))


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty if columns, kinds and rows agree exactly, in any order."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    found = spark_df.collect()
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP"}
    wrong = []
    types = {d[0]: str(d[1]) for d in result.description}
    for name, kind in spark_df.dtypes:
        if kinds.get(kind, kind) != types[name] and not (kind == "timestamp_ntz" and "TIMESTAMP" in types[name]):
            wrong.append(f"type of {name}: {kind} / {types[name]}")
    order = sorted(names)
    at = {n: i for i, n in enumerate(names)}
    a = sorted(tuple(_plain(r[n]) for n in order) for r in found)
    b = sorted(tuple(_plain(r[at[n]]) for n in order) for r in expected)
    if len(a) != len(b):
        wrong.append(f"{len(a)} rows, expected {len(b)}")
    elif a != b:
        off = [(x, y) for x, y in zip(a, b) if x != y]
        wrong.append(f"{len(off)} of {len(a)} rows differ, first {off[0]}")
    return wrong
