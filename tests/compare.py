"""A query's rows beside those of its SQL."""

import glob
import os

import duckdb
import pandas as pd


def tables(directory):
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else f"{value:.6g}"
    if hasattr(value, "__len__") and not isinstance(value, str):
        return str([plain(v) for v in value])
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))
