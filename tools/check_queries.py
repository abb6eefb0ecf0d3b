"""Run registered queries beside their DuckDB check and report differences.

usage: python tools/check_queries.py [--sf sf0.01] [name-fragment ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from voxmill.catalog import CHECKS, QUERIES, runner
from voxmill.derived import BASE


KINDS = {"bool": ("bool",), "float": ("double", "float", "decimal"), "int": ("int", "long", "short", "byte"),
         "text": ("string", "varchar"), "time": ("timestamp",)}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def main():
    args = sys.argv[1:]
    sf = "sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    folder = f"/root/testdata/{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{folder}/{b}.parquet'")
    bad = 0
    for name in QUERIES:
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            df = runner(name)(spark, folder)
            cols, got = rows_of(df.columns, df.collect())
            t1 = time.time() - t0
            if name not in CHECKS:
                print(f"rows  {name:38s} {len(got):7d} rows {t1:6.2f}s")
                continue
            cur = con.execute(CHECKS[name])
            ecols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            types = {d[0]: str(d[1]) for d in cur.description}
            loose = [c for c, t in types.items() if t.startswith(("HUGEINT", "DECIMAL"))]
            ok = cols == ecols and got == want
            kind = lambda t: next((k for k, names in KINDS.items() if any(n in t.lower() for n in names)), t)
            mixed = {c: (t.simpleString(), types[c]) for c, t in ((f.name, f.dataType) for f in df.schema) if c in types and kind(t.simpleString()) != kind(types[c])}
            if mixed:
                print("   kinds", name, mixed)
            bad += not ok
            print(f"{'ok   ' if ok else 'DIFF '} {name:38s} {len(got):7d} rows {t1:6.2f}s  duck {time.time() - t0 - t1:5.2f}s"
                  + (f"  loose types {loose}" if loose else ""))
            if not ok:
                print("   cols", cols, ecols)
                print("   n", len(got), len(want))
                d = [(a, b) for a, b in zip(got, want) if a != b][:4]
                for a, b in d:
                    print("   spark", a, "\n   duck ", b)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:1500]}")
        sys.stdout.flush()
    print("problems:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
