"""Run registered queries in Spark and their SQL in DuckDB and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT",
                 "timestamp": "TIMESTAMP WITH TIME ZONE"}


def type_mismatches(sdf, con, sql):
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}


def key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sorted(sdf.columns)
    srows = [tuple(norm(r[c]) for c in scols) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), t=t1 - t0)
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows_raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(dcols)}
    if sorted(dcols) != scols:
        return dict(name=name, ok=False, why=f"cols spark={scols} duck={sorted(dcols)}", t=t1 - t0)
    bad_types = type_mismatches(sdf, con, sql)
    if bad_types:
        return dict(name=name, ok=False, why=f"types {bad_types}", t=t1 - t0)
    drows = [tuple(norm(r[idx[c]]) for c in scols) for r in drows_raw]
    if len(drows) != len(srows):
        return dict(name=name, ok=False, why=f"rows spark={len(srows)} duck={len(drows)}", t=t1 - t0)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    for x, y in zip(a, b):
        if x != y:
            return dict(name=name, ok=False, why=f"first diff spark={x} duck={y}", t=t1 - t0)
    return dict(name=name, ok=True, rows=len(srows), t=t1 - t0)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    from quarry.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, con, name, qs[name], os_.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:300]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
