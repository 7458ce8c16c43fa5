"""Comparison of a query's rows with those of its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata/sf0.001"


def views(sf_dir: str = DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if v == int(v) else float(v)
    return int(v) if isinstance(v, (int, np.integer)) else str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    names = sorted(frame.columns)
    return sorted(repr([plain(x) for x in r]) for r in frame[names].astype(object).itertuples(index=False, name=None))
