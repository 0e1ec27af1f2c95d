"""Rows of a query and of its SQL, in one comparable form."""

import glob
import os
from decimal import Decimal

import duckdb
import pandas as pd


def views(folder: str):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x) or str(x) == "NaT":
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, Decimal)) or hasattr(x, "item") and not hasattr(x, "tolist"):
        return round(float(x), 6)
    if hasattr(x, "tolist"):
        x = x.tolist()
        return str(x) if isinstance(x, list) else cell(x)
    return str(x)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr([cell(x) for x in r]) for r in df.astype(object).itertuples(index=False))
