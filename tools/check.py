"""Run registered queries against their DuckDB texts: ``python tools/check.py [folder] [name part ...]``."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from playbill.plans.views import TABLES


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    if isinstance(value, int):
        return value
    return str(value)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, run, sql):
    start = time.time()
    df = run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if not sql:
        return "rows-only", f"{len(rows)} rows", took
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return "SCHEMA", f"{sorted(df.columns)} vs {sorted(want_cols)}", took
    got_hash, got_lines = digest(df.columns, rows)
    want_hash, want_lines = digest(want_cols, want)
    types = dict(df.dtypes), {c[0]: str(c[1]) for c in cur.description}
    if got_hash == want_hash:
        return ("ok" if rows else "EMPTY"), f"{len(rows)} rows", took
    only_got = [x for x in got_lines if x not in set(want_lines)][:3]
    only_want = [x for x in want_lines if x not in set(got_lines)][:3]
    return "DIFF", f"{len(rows)} vs {len(want)}\n   spark {only_got}\n   duck  {only_want}\n   {sorted(df.columns)} {types}", took


def main():
    from playbill.plans import catalog
    from playbill.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, each in catalog.entries().items():
        if args and not any(a in name or a in each.covers or a in {c.rstrip("0123456789") for c in each.covers} for a in args):
            continue
        try:
            status, note, took = compare(spark, con, folder, name, each.run, each.sql)
        except Exception as e:
            status, note, took = "ERROR", "".join(traceback.format_exception_only(e))[:1500], 0.0
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {took:6.2f}s {name} {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
