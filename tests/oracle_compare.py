"""Differential check: Spark query vs DuckDB oracle SQL on the same parquet.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
Compares row counts, column names and the multiset of rows (columns sorted
by name), the way the round driver does.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(float(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def canon(cols: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    out = sorted(tuple(_norm(r[k]) for k in order) for r in rows)
    return [cols[k] for k in order], out


def compare(spark, key: str, sf_dir: str, con=None, verbose: bool = True) -> bool:
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    t0 = time.time()
    df = E.queries()[key](spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = E.oracle_sql().get(key)
    if sql is None:
        if verbose:
            print(f"{key:40s} NO-ORACLE rows={len(s_rows)} spark={t1 - t0:.1f}s")
        return True
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = canon(df.columns, s_rows)
    dc, dr = canon(d_cols, d_rows)
    ok = sc == dc and sr == dr
    if verbose:
        print(f"{key:40s} {'OK ' if ok else 'BAD'} rows spark={len(sr)} duck={len(dr)} spark={t1 - t0:.1f}s")
        if not ok:
            if sc != dc:
                print("   cols spark:", sc)
                print("   cols duck :", dc)
            else:
                a, b = set(sr), set(dr)
                for r in sorted(a - b)[:5]:
                    print("   spark only:", r)
                for r in sorted(b - a)[:5]:
                    print("   duck only :", r)
    return ok


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    from retentia.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", shuffle_partitions=8,
                        extra_conf={"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = []
    for key in keys or sorted(E.queries()):
        try:
            if not compare(spark, key, sf_dir, con):
                bad.append(key)
        except Exception as exc:  # report and go on
            print(f"{key:40s} ERROR {type(exc).__name__}: {str(exc)[:400]}")
            bad.append(key)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
