"""Order-free comparison of a Spark result with DuckDB's."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, (list, dict)) or hasattr(v, "shape") and getattr(v, "shape", ()) != ():
        return str(list(v))
    if v is None or pd.isna(v):
        return None
    if hasattr(v, "strftime"):
        return v.strftime("%Y-%m-%d")
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 6)
    return str(v)


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)
