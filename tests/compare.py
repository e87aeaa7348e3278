"""Rows of a Spark result and of DuckDB SQL on the same tables, in a form that compares."""

import os

import duckdb
import numpy as np
import pandas as pd


def rows(pdf):
    def plain(v):
        if isinstance(v, list | tuple | np.ndarray):
            return tuple(plain(x) for x in v)
        if isinstance(v, bool | np.bool_):
            return bool(v)
        if isinstance(v, int | np.integer):
            return int(v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, float) else v if isinstance(v, str) else str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


def sql_rows(folder, sql):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con.execute(sql).df()


def same(a, b):
    """Equal rows; floats may differ in the last digit that was kept."""
    if len(a) != len(b):
        return False
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            if isinstance(u, float) and isinstance(v, float):
                if abs(u - v) > 1e-4 * max(1.0, abs(u)):
                    return False
            elif u != v:
                return False
    return True
