"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def rows(columns, values):
    """Values as sorted text rows, columns by name; floats to four digits."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)
