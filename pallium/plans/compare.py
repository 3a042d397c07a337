"""Side-by-side check of a registered query against its DuckDB oracle.

Mirrors what the driver records: row count, column names, and an
order-insensitive hash of the values (columns sorted by name).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os

from pallium.session import TABLES


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd

        if v is pd.NaT:
            return None
    except Exception:  # pragma: no cover
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def frame_digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted(
        (repr(tuple(_norm(x) for x in r)) for r in pdf[cols].itertuples(index=False, name=None))
    )
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return cols, len(rows), h, rows


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name: str, sf_dir: str, con=None, show: int = 3) -> dict:
    from pallium.plans import all_queries, all_oracles

    fn = all_queries()[name]
    sql = all_oracles().get(name)
    sdf = fn(spark, sf_dir).toPandas()
    out = {"name": name, "spark_rows": len(sdf)}
    if sql is None:
        out["oracle"] = False
        return out
    con = con or duck_connection(sf_dir)
    ddf = con.execute(sql).fetchdf()
    s_cols, s_n, s_h, s_rows = frame_digest(sdf)
    d_cols, d_n, d_h, d_rows = frame_digest(ddf)
    out.update(oracle=True, duck_rows=d_n, cols_match=s_cols == d_cols, hash_match=s_h == d_h)
    if not (out["cols_match"] and out["hash_match"]):
        out["spark_cols"] = s_cols
        out["duck_cols"] = d_cols
        only_s = sorted(set(s_rows) - set(d_rows))[:show]
        only_d = sorted(set(d_rows) - set(s_rows))[:show]
        out["only_spark"] = [r[:400] for r in only_s]
        out["only_duck"] = [r[:400] for r in only_d]
    return out
