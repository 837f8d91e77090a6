"""Runs a query and its DuckDB SQL on one data folder and compares rows, regardless of order."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def normal(df):
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return bool(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v

    df = df[sorted(df.columns)]
    return sorted((tuple(one(v) for v in row) for row in df.itertuples(index=False, name=None)), key=repr)


def differences(spark, query, sql, folder):
    ours = query(spark, str(folder)).toPandas().astype(object)
    theirs = connect(folder).execute(sql).df().astype(object)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = normal(ours), normal(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y:
            bad = [(c, p, q) for c, p, q in zip(sorted(ours.columns), x, y, strict=True) if p != q]
            return f"rows differ: {bad[:6]}"
    return ""
