"""Run the registered queries against their SQL in DuckDB.

usage: python tests/oracle.py [sf folder] [name part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .appName("tablewise")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .getOrCreate()
    )


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return f"{v}"


def _norm(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    """None when both sides agree, else a short description of the difference."""
    df = fn(spark, folder)
    a_names, a = _norm(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if df.columns else "no columns"
    cur = con.execute(sql)
    b_names, b = _norm([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} rows != {len(b)}\n   spark {only_a}\n   sql   {only_b}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out = [f"{len(bad)} of {len(a)} rows differ"]
        for x, y in bad[:3]:
            out += ["   " + str([(n, p, q) for n, p, q in zip(a_names, x, y) if p != q])]
        return "\n".join(out)
    return None


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    import workload

    spark, con = session(), duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, fn in workload.QUERIES.items():
        if argv[1:] and not any(p in name for p in argv[1:]):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, name, fn, workload.ORACLES.get(name), folder)
        except Exception as exc:  # report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += diff is not None
        mark = "FAIL" if diff else ("ok" if name in workload.ORACLES else "rows")
        print(f"{mark:5}{time.time() - start:6.1f}s  {name}" + (f"\n   {diff}" if diff else ""), flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
