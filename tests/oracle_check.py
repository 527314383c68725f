"""Run registered queries and their SQL twins side by side.

usage: python tests/oracle_check.py [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str:
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} <> {sorted(duck_cols)}"
    so = [spark_cols.index(c) for c in sorted(spark_cols)]
    do = [duck_cols.index(c) for c in sorted(duck_cols)]
    a = sorted([tuple(norm(r[i]) for i in so) for r in spark_rows], key=repr)
    b = sorted([tuple(norm(r[i]) for i in do) for r in duck_rows], key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}"
    for i, _ in enumerate(so):
        ta = {type(r[i]).__name__ for r in a if r[i] is not None}
        tb = {type(r[i]).__name__ for r in b if r[i] is not None}
        if ta != tb:
            return f"types of {sorted(spark_cols)[i]}: {ta} <> {tb}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first spark={bad[0][0]!r:.400} duck={bad[0][1]!r:.400}"
    return ""


def check(spark, con, sf: str, name: str) -> tuple[str, int, float]:
    from reelgrid.plans import load_all
    from reelgrid.plans.registry import ORACLES, QUERIES

    load_all()
    t = time.time()
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    took = time.time() - t
    if name not in ORACLES:
        return "", len(rows), took
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    return compare([tuple(r) for r in rows], df.columns, cur.fetchall(), cols), len(rows), took


def main() -> None:
    from reelgrid.plans import load_all
    from reelgrid.plans.registry import ORACLES, QUERIES
    from reelgrid.session import get_session

    load_all()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("check", "local[8]", 8, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = [n for n in QUERIES if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    bad = 0
    for n in names:
        try:
            msg, rows, took = check(spark, con, sf, n)
        except Exception as e:  # noqa: BLE001
            msg, rows, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        flag = "FAIL" if msg else ("ok" if n in ORACLES else "rows")
        bad += bool(msg)
        print(f"{flag:5} {n:34} {rows:8} {took:6.2f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
