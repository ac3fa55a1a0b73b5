"""Run registered queries in Spark and their SQL in DuckDB and compare.

usage: check_oracle.py [--sf DIR] [--only PREFIX[,PREFIX...]] [--slow]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if v is None:
        return "null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def kind(spark_type: str) -> str:
    t = spark_type.lower()
    return {"string": "varchar", "long": "bigint"}.get(t, t)


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    cols = df.columns
    types = {c: kind(t) for c, t in df.dtypes}
    rows = df.collect()
    t1 = time.time()
    if sql is None:
        return "rows", len(rows), t1 - t0, 0.0, ""
    rel = con.sql(sql)
    dcols, dtypes = rel.columns, [str(t).lower() for t in rel.types]
    drows = rel.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(dcols):
        return "COLUMNS", len(rows), t1 - t0, t2 - t1, f"{sorted(cols)} vs {sorted(dcols)}"
    order = sorted(cols)
    si, di = [cols.index(c) for c in order], [dcols.index(c) for c in order]
    a = sorted(tuple(canon(r[i]) for i in si) for r in rows)
    b = sorted(tuple(canon(r[i]) for i in di) for r in drows)
    off = [f"{c}:{types[c]}/{dtypes[dcols.index(c)]}" for c in order if types[c] != dtypes[dcols.index(c)]]
    note = ("types " + " ".join(off)) if off else ""
    if a == b:
        return "ok", len(rows), t1 - t0, t2 - t1, note
    sa, sb = set(a), set(b)
    return "DIFF", len(rows), t1 - t0, t2 - t1, f"{len(b)} rows in SQL; spark only {list(sa - sb)[:2]}; sql only {list(sb - sa)[:2]} {note}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("--only", default="")
    a = ap.parse_args()
    import duckdb

    from textprov.plans import catalogue
    from textprov.session import local_session

    spark = local_session("check", cpus=8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = 0
    only = [p for p in a.only.split(",") if p]
    for name, fn in catalogue.QUERIES.items():
        if only and not any(name.startswith(p) for p in only):
            continue
        try:
            res = compare(spark, con, a.sf, name, fn, catalogue.SQL.get(name))
        except Exception as e:
            res = ("ERROR", 0, 0.0, 0.0, f"{type(e).__name__} {str(e)[:700]}")
        status, n, ts, td, note = res
        bad += status not in ("ok", "rows")
        print(f"{status:8s} {name:28s} rows={n:7d} spark={ts:6.2f}s duckdb={td:6.2f}s {note[:900]}", flush=True)
    print("not equal:", bad)
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
