"""Run registered queries next to their DuckDB statements and report differences.

usage: python tools/compare.py [sf_dir] [name-fragment ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from packlens.catalog.all_queries import all_queries  # noqa: E402
from packlens.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.9g}"
    if isinstance(v, bool):
        return f"bool:{v}"
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 1e9 else str(v)
    return f"{type(v).__name__}:{v}"


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    wanted = [a for a in args if "/" not in a]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name, q in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf_dir)
            got = df.collect()
            took = time.time() - t0
            names, rows = table(df.columns, got)
            if q.sql is None:
                print(f"rows  {name}: {len(rows)} rows {took:.1f}s", flush=True)
                continue
            t1 = time.time()
            cur = con.execute(q.sql)
            onames, orows = table([d[0] for d in cur.description], cur.fetchall())
            otook = time.time() - t1
            same = names == onames and rows == orows
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(rows)} rows {took:.1f}s (duckdb {otook:.1f}s)", flush=True)
            if not same:
                bad.append(name)
                if names != onames:
                    print("   columns", names, onames)
                else:
                    a, b = set(rows), set(orows)
                    print(f"   spark {len(rows)} duck {len(orows)}", names)
                    for r in sorted(a - b)[:3]:
                        print("   spark only", r)
                    for r in sorted(b - a)[:3]:
                        print("   duck only ", r)
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(exc)[:900]}", flush=True)
            if "-v" in args:
                traceback.print_exc()
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
