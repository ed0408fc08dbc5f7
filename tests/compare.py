"""Side-by-side check of a Spark result and DuckDB's: same columns, same types, same rows in any order."""
from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{os.path.join(sf_dir, t)}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def kind(value) -> str:
    name = type(value).__name__
    return {"datetime64": "Timestamp"}.get(name, name)


def canon(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (0, "") if math.isnan(value) else (1, f"{value + 0.0:.10g}")
    return (1, str(value))


def differences(spark_df, con, sql: str) -> list[str]:
    """Readable differences; empty when equal. Floats compare to about ten digits, types exactly."""
    names = sorted(spark_df.columns)
    mine = [tuple(r[n] for n in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return [f"columns {names} against {sorted(cols)}"]
    order = [cols.index(n) for n in names]
    theirs = [tuple(r[i] for i in order) for r in cur.fetchall()]
    out = []
    if len(mine) != len(theirs):
        out.append(f"{len(mine)} rows against {len(theirs)}")
    for i, n in enumerate(names):
        a, b = ({kind(r[i]) for r in rows if r[i] is not None} for rows in (mine, theirs))
        if a and b and a != b:
            out.append(f"type of {n}: {a} against {b}")
    a, b = (sorted(tuple(canon(v) for v in r) for r in rows) for rows in (mine, theirs))
    if a != b:
        only_a, only_b = list(set(a) - set(b)), list(set(b) - set(a))
        show = lambda rows: [[v[1] for v in r] for r in sorted(rows)[:2]]
        out.append(f"{names}: {len(only_a)} only in spark {show(only_a)}, {len(only_b)} only in duckdb {show(only_b)}")
    return out
