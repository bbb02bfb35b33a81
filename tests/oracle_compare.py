"""Side-by-side check of every registered query against its DuckDB oracle.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Prints one line per query and exits non-zero on any mismatch.
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402,I001

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=_key)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare_one(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    compare_one.last_plan = sdf._jdf.queryExecution().executedPlan().toString()
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_types = {d[0]: str(d[1]) for d in res.description}
    d_rows = res.fetchall()
    t2 = time.time()
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    type_diff = {k: (s_types.get(k), d_types.get(k)) for k in set(s_types) | set(d_types) if s_types.get(k) != d_types.get(k)}
    ok = sc == dc and not type_diff and len(sr) == len(dr) and sr == dr
    detail = ""
    if sc != dc:
        detail = f"columns spark={sc} duck={dc}"
    elif type_diff:
        detail = f"types {type_diff}"
    elif len(sr) != len(dr):
        detail = f"rows spark={len(sr)} duck={len(dr)}"
    elif sr != dr:
        diffs = [(a, b) for a, b in zip(sr, dr) if a != b]
        detail = f"{len(diffs)} differing rows, first: spark={diffs[0][0]} duck={diffs[0][1]}"
    return ok, len(sr), t1 - t0, t2 - t1, detail


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as entry
    from raterkit.session import local_session

    spark = local_session(8)
    con = duck(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in oracle:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(f"NO-ORACLE {name}: rows={n}", flush=True)
            continue
        try:
            ok, n, ts, td, detail = compare_one(spark, con, name, qs[name], oracle[name], sf_dir)
        except Exception as e:  # report and continue
            ok, n, ts, td, detail = False, -1, 0, 0, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: rows={n} spark={ts:.1f}s duck={td:.1f}s {detail}", flush=True)
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
