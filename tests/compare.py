"""Spark-vs-DuckDB comparison in the manner of the driver's correctness check."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records")]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, con, sql: str) -> dict:
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    res = {"spark_rows": len(s), "oracle_rows": len(d),
           "cols_equal": sorted(s.columns) == sorted(d.columns)}
    if res["cols_equal"]:
        rs, rd = rows(s), rows(d)
        res["values_equal"] = rs == rd
        if not res["values_equal"]:
            diff = [(a, b) for a, b in zip(rs, rd) if a != b][:2]
            res["first_diff"] = diff
    else:
        res["spark_cols"], res["oracle_cols"] = sorted(s.columns), sorted(d.columns)
    return res
