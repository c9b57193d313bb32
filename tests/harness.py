"""Side-by-side check of a registered query against its DuckDB oracle.

Mirrors the driver's gate: column names compared sorted, row counts, and an
order-insensitive comparison of all values (exact; doubles also reported with a
relative tolerance so a last-bit difference is visible as such).
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v, tol):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) if tol else v
    if isinstance(v, Decimal):
        return v
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in row)


def compare(spark, name: str, sf_dir: str, fn, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    t2 = time.time()
    scols = sdf.columns
    out = {"name": name, "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2),
           "rows": (len(srows), len(drows))}
    if sorted(scols) != sorted(dcols):
        out["ok"] = False
        out["why"] = f"columns differ: spark-only {sorted(set(scols) - set(dcols))} duck-only {sorted(set(dcols) - set(scols))}"
        return out
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    for tol in (False, True):
        s = sorted((tuple(_norm(r[i], tol) for i in si) for r in srows), key=_key)
        d = sorted((tuple(_norm(r[i], tol) for i in di) for r in drows), key=_key)
        if s == d:
            out["ok"] = not tol
            if tol:
                out["why"] = "equal only after rounding doubles"
            break
    else:
        out["ok"] = False
        diffs = []
        for a, b in zip(s, d):
            if a != b:
                diffs.append({c: (x, y) for c, x, y in zip(order, a, b) if x != y})
                if len(diffs) >= 3:
                    break
        out["why"] = f"values differ, e.g. {diffs}"
    return out


def main(names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from meterwise.session import local_session

    spark = local_session()
    sf = "/root/testdata/sf0.01"
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for n in names or list(qs):
        if n not in sqls:
            df = qs[n](spark, sf)
            print({"name": n, "rows_only": df.count()})
            continue
        try:
            r = compare(spark, n, sf, qs[n], sqls[n], con)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += not r["ok"]
        print(r, flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
