"""Run every registered query and its SQL twin and compare the rows.

usage: python tests/check_oracle.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from tapline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, Decimal):
        return ("d", str(x))
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session(8, partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    if "CHECK_TZ" in os.environ:
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_TZ"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    oracle = entry_module.oracle_sql()
    bad = 0
    for name, run in entry_module.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = run(spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - started
            if name not in oracle:
                print(f"{name}: {len(got[1])} rows, no SQL, {spent:.1f}s", flush=True)
                continue
            cur = con.execute(oracle[name])
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
            ok = got == want
            note = "" if want[1] else " EMPTY"
            print(f"{'ok  ' if ok else 'FAIL'} {name}: {len(got[1])} / {len(want[1])} rows, {spent:.1f}s{note}", flush=True)
            if not ok:
                bad += 1
                if got[0] != want[0]:
                    print("   columns", got[0], want[0])
                a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                for r in sorted(a - b)[:3]:
                    print("   spark ", r[:400])
                for r in sorted(b - a)[:3]:
                    print("   oracle", r[:400])
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {type(exc).__name__} {str(exc)[:700]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
