"""Compare registered queries with their SQL twins (developer tool).

Usage: python tests/check_tool.py [key-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from codesieve.session import local_session  # noqa: E402

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def compare(spark, con, key, build, sql):
    t0 = time.time()
    df = build(spark, SF)
    cols = sorted(df.columns)
    left = sorted(tuple(canonical(v) for v in row) for row in df.select(*cols).collect())
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(left):7d}  spark {t1 - t0:5.2f}s"
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if names != cols:
        return f"COLUMNS {cols} vs {names}"
    order = [rel.columns.index(c) for c in cols]
    right = sorted(tuple(canonical(row[i]) for i in order) for row in rel.fetchall())
    t2 = time.time()
    tag = "ok" if left == right else "DIFF"
    out = f"{tag} {len(left):7d} vs {len(right):7d}  spark {t1 - t0:5.2f}s duck {t2 - t1:5.2f}s"
    if left != right:
        a, b = set(left), set(right)
        out += f"\n   cols {cols}\n   spark-only {sorted(a - b)[:3]}\n   duck-only  {sorted(b - a)[:3]}"
    return out


def main(prefixes):
    spark = local_session(os.environ.get("CHECK_CPUS", "8"))
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    builders, sqls = entry.queries(), entry.oracle_sql()
    for key in builders:
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        try:
            print(f"{key:28s} {compare(spark, con, key, builders[key], sqls.get(key))}", flush=True)
        except Exception as error:  # noqa: BLE001 - keep going over all keys
            print(f"{key:28s} ERROR {type(error).__name__}: {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
