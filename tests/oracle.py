"""Compare a Spark DataFrame with a DuckDB oracle query on the same parquet tables."""

from __future__ import annotations

import math

import duckdb

from workrisk.sources.driver import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, places=6):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, places) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, places)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True), places)
    return v


SPARK_TO_DUCK = {"StringType": "VARCHAR", "DoubleType": "DOUBLE", "LongType": "BIGINT", "IntegerType": "INTEGER",
                 "BooleanType": "BOOLEAN", "FloatType": "FLOAT"}


def type_mismatches(spark_df, con, sql):
    """Columns whose Spark type and DuckDB result type differ."""
    st = {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
          for f in spark_df.schema.fields}
    rel = con.sql(sql)
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}


def compare(spark_df, con, sql, places=9, show=5, check_types=False):
    """Return (ok, message). Columns are matched by name; rows order-insensitively."""
    if check_types:
        bad = type_mismatches(spark_df, con, sql)
        if bad:
            return False, f"types differ: {bad}"
    sp_cols = sorted(spark_df.columns)
    rows = [tuple(_norm(r[c], places) for c in sp_cols) for r in spark_df.collect()]
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows_raw = rel.fetchall()
    if sorted(dcols) != sp_cols:
        return False, f"columns differ: spark={sp_cols} duck={sorted(dcols)}"
    idx = [dcols.index(c) for c in sp_cols]
    drows = [tuple(_norm(r[i], places) for i in idx) for r in drows_raw]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(rows, key=key), sorted(drows, key=key)
    if len(a) != len(b):
        return False, f"row counts differ: spark={len(a)} duck={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {bad[:show]}"
    return True, f"{len(a)} rows match"
