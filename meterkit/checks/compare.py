"""Side-by-side check of a registered query against its DuckDB twin.

Compares row count, column names and an order-insensitive multiset of
normalised rows, the way the driver's correctness gate does.
"""

from __future__ import annotations

import datetime as dt
import math

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def duckdb_rows(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def compare(df, sql: str, sf_dir: str) -> dict:
    s_cols = df.columns
    s_rows = df.collect()
    o_cols, o_rows = duckdb_rows(sql, sf_dir)
    order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    order_o = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
    s_set = sorted((tuple(_norm(r[i]) for i in order_s) for r in s_rows), key=repr)
    o_set = sorted((tuple(_norm(r[i]) for i in order_o) for r in o_rows), key=repr)
    result = {
        "spark_rows": len(s_rows),
        "oracle_rows": len(o_rows),
        "columns_match": sorted(s_cols) == sorted(o_cols),
        "values_match": s_set == o_set,
    }
    if not result["values_match"]:
        diff_s = [r for r in s_set if r not in set(o_set)][:3]
        diff_o = [r for r in o_set if r not in set(s_set)][:3]
        result["spark_only"] = diff_s
        result["oracle_only"] = diff_o
        result["columns"] = (s_cols, o_cols)
    return result
