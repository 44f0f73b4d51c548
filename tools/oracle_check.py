"""Run suite queries on Spark and their SQL twins on DuckDB and compare
row counts, column names and order-insensitive values (local check tool)."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sieveworks.session import build_session  # noqa: E402
from sieveworks.suite import ORACLE, QUERIES  # noqa: E402
from sieveworks.suite.common import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return repr(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in rows]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    names = args.names or sorted(QUERIES)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in ORACLE:
            print(f"{name:32s} rows={len(rows):7d} (no oracle) {dt:.1f}s")
            continue
        try:
            res = con.execute(ORACLE[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:32s} SQL-ERROR {str(exc)[:300]}")
            bad += 1
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        otypes = {d[0]: str(d[1]) for d in res.description}
        fam = {"bigint": "int64", "BIGINT": "int64", "int": "int32", "INTEGER": "int32", "double": "float64",
               "DOUBLE": "float64", "string": "str", "VARCHAR": "str", "boolean": "bool", "BOOLEAN": "bool",
               "HUGEINT": "int128", "float": "float32", "FLOAT": "float32", "smallint": "int16"}
        tdiff = {c: (stypes.get(c), otypes.get(c)) for c in cols
                 if fam.get(stypes.get(c), stypes.get(c)) != fam.get(otypes.get(c), otypes.get(c))}
        if tdiff:
            print(f"{name:32s} TYPES {tdiff}")
        a, b = sorted(canon(cols, rows)), sorted(canon(ocols, orows))
        ok = ok_cols and a == b
        if not ok:
            bad += 1
            diff = [x for x in a if x not in set(b)][:2]
            diff2 = [x for x in b if x not in set(a)][:2]
            print(f"{name:32s} MISMATCH cols={ok_cols} {sorted(cols)} vs {sorted(ocols)} rows {len(a)} vs {len(b)}")
            print("   spark-only:", str(diff)[:600])
            print("   sql-only:  ", str(diff2)[:600])
        else:
            print(f"{name:32s} OK rows={len(rows):7d} {dt:.1f}s")
    print("bad", bad, "of", len(names))


if __name__ == "__main__":
    main()
