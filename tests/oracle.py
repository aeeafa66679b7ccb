"""Local copy of the correctness gate: Spark query vs DuckDB SQL on the same parquet."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(base: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(base, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "as_tuple"):  # Decimal
        return round(float(v), 6)
    return v


def compare(spark_df, con, sql: str):
    """Returns (ok, message)."""
    pdf = spark_df.toPandas()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    rows = res.fetchall()
    s_cols = sorted(pdf.columns)
    if sorted(cols) != s_cols:
        return False, f"columns differ: spark={sorted(pdf.columns)} sql={sorted(cols)}"
    if len(rows) != len(pdf):
        return False, f"row count spark={len(pdf)} sql={len(rows)}"
    idx = [cols.index(c) for c in s_cols]
    a = sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)
    recs = pdf[s_cols].astype(object).where(pdf[s_cols].notna(), None).itertuples(index=False)
    b = sorted((tuple(_norm(v) for v in r) for r in recs), key=repr)
    for x, y in zip(a, b):
        if x != y:
            for c, u, v in zip(s_cols, x, y):
                if u != v and not (isinstance(u, float) and isinstance(v, float) and abs(u - v) < 1e-6):
                    return False, f"value differs in {c}: sql={u!r} spark={v!r}"
    return True, f"{len(rows)} rows"
