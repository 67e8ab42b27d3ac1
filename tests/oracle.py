"""Comparing a Spark result with DuckDB's, without regard to the order of rows."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd

from tessera.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x) -> str:
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_value, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return str(int(x)) if float(x).is_integer() else f"{float(x):.6g}"
    return str(x)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_value(v) for v in row) for row in frame.itertuples(index=False))
