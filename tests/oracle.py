"""Comparison of a query with its DuckDB statement."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _value(x):
    if isinstance(x, (float, np.floating)):
        return None if x != x else round(float(x), 9)
    if isinstance(x, np.integer):
        return int(x)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(_value(y) for y in x)
    return None if x is pd.NaT else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_value(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)
