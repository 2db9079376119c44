"""Run registered queries next to their SQL in DuckDB and compare rows.

Usage: python tests/oracle_check.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(rows, order):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, run, sql):
    """Return (ok, message)."""
    df = run(spark, folder)
    left_cols = df.columns
    left = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(left) > 0, f"{len(left)} rows, no SQL"
    rel = con.execute(sql)
    right_cols = [d[0] for d in rel.description]
    right = rel.fetchall()
    if sorted(left_cols) != sorted(right_cols):
        return False, f"columns {left_cols} vs {right_cols}"
    names = sorted(left_cols)
    a = canonical(left, [left_cols.index(c) for c in names])
    b = canonical(right, [right_cols.index(c) for c in names])
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return False, f"rows {len(a)} vs {len(b)}; only here {only_a}; only SQL {only_b}"
    return len(a) > 0, f"{len(a)} rows"


def main() -> int:
    from tissuegrid.plans import catalog
    from tissuegrid.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, run in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, folder, run, catalog.ORACLES.get(name))
        except Exception as exc:  # report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
