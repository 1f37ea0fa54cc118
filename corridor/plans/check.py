"""Compare registered Spark queries with their DuckDB oracles.

    python -m corridor.plans.check [--sf-dir DIR] [--explain] [name-prefix ...]

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows after sorting columns by name (floats compared at 6 dp).
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import math
import sys
import time

import duckdb

from ..sources.tables import TABLES, table_path


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols]
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf.itertuples(index=False, name=None))


def kind(dtype) -> str:
    s = str(dtype)
    if "int" in s:
        return "int"
    if "float" in s:
        return "float"
    if "bool" in s:
        return "bool"
    if "datetime" in s:
        return "time"
    return "obj"


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    dk = con.execute(sql).df()
    res = {"name": name, "spark_rows": len(sp), "oracle_rows": len(dk), "spark_s": round(t1 - t0, 2)}
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dk)
    res["columns_ok"] = sc == dc
    res["rows_ok"] = len(sr) == len(dr)
    res["values_ok"] = sr == dr
    if sc == dc:
        strict = {c: (str(sp[c].dtype), str(dk[c].dtype)) for c in sc
                  if str(sp[c].dtype) != str(dk[c].dtype) and len(sp)}
        if strict:
            res["dtype_notes"] = strict
        res["types_ok"] = all(kind(sp[c].dtype) == kind(dk[c].dtype) or len(sp) == 0 for c in sc)
        if not res["types_ok"]:
            res["types"] = {c: (str(sp[c].dtype), str(dk[c].dtype)) for c in sc
                            if kind(sp[c].dtype) != kind(dk[c].dtype)}
    else:
        res["columns"] = (sc, dc)
    if not res["values_ok"] and sc == dc:
        a, b = set(sr), set(dr)
        res["only_spark"] = sorted(a - b)[:3]
        res["only_oracle"] = sorted(b - a)[:3]
    res["ok"] = res["columns_ok"] and res["rows_ok"] and res["values_ok"] and res.get("types_ok", False)
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--explain", action="store_true",
                    help="print explain('formatted') of the selected queries instead of checking")
    ap.add_argument("prefix", nargs="*")
    a = ap.parse_args(argv)
    from ..session import build_session
    from . import oracle_sql, queries
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(a.sf_dir)
    qs, os_ = queries(), oracle_sql()
    if a.explain:
        for name in sorted(qs):
            if not a.prefix or any(name.startswith(p) for p in a.prefix):
                print(f"== {name}")
                qs[name](spark, a.sf_dir).explain("formatted")
        return 0
    bad = 0
    for name in sorted(qs):
        if a.prefix and not any(name.startswith(p) for p in a.prefix):
            continue
        if name not in os_:
            n = qs[name](spark, a.sf_dir).count()
            print(json.dumps({"name": name, "spark_rows": n, "oracle": None}))
            continue
        try:
            r = compare(spark, name, qs[name], os_[name], a.sf_dir, con)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "error": f"{type(e).__name__}: {str(e)[:600]}"}
        bad += not r["ok"]
        print(json.dumps(r, default=str))
        sys.stdout.flush()
    print(f"FAILED {bad}" if bad else "ALL OK")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
