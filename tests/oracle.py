"""Comparing a query with its SQL on the same files."""

import os
import re

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return v

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


def expected(sql: str, sf_dir: str = SMALL) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            at = f"{sf_dir}/{t}.parquet"
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con.sql(sql).df()
