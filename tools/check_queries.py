"""Run registered queries next to their SQL and compare the results exactly.

usage: check_queries.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.catalog import REGISTRY  # noqa: E402
from tidemark.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canon(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return repr(value + 0.0)
    return str(value)


def rows_of(pairs):
    names, rows = pairs
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(canon(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, v or "") for v in r)
    )


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = sys.argv[2:]
    spark = build_session("check", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g", spark__log__level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, q in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, sf_dir)
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            got = rows_of((df.columns, [tuple(r) for r in df.collect()]))
            t1 = time.time()
            if q.sql is None:
                print(f"RAN   {name} rows={len(got[1])} spark={t1 - t0:.2f}s", flush=True)
                continue
            cur = con.execute(q.sql)
            names = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            want = rows_of((names, cur.fetchall()))
            t2 = time.time()
            if got[0] == want[0] and got[1] == want[1]:
                dec = [n for n, k in kinds.items() if "DECIMAL" in k or "HUGEINT" in k or "NUMBER" == k and False]
                note = f" TYPES {dec}" if dec else ""
                print(f"OK    {name} rows={len(got[1])} spark={t1 - t0:.2f}s duck={t2 - t1:.2f}s{note}", flush=True)
            else:
                bad += 1
                print(f"DIFF  {name} rows {len(got[1])} vs {len(want[1])} cols {got[0]} vs {want[0]}")
                gs, ws = set(got[1]), set(want[1])
                for r in [r for r in got[1] if r not in ws][:4]:
                    print("   spark", r)
                for r in [r for r in want[1] if r not in gs][:4]:
                    print("   duck ", r)
                print("  ", types, kinds, flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name} {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
