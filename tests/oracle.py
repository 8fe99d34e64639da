"""Side-by-side comparison of registered queries with their SQL.

Usage: python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v) + 0.0
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    data.sort(key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    return [columns[i] for i in order], data


def compare(con, spark, build, sql, sf_dir):
    t0 = time.time()
    df = build(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    t1 = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    problem = None
    if got_cols != want_cols:
        problem = f"columns {got_cols} vs {want_cols}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} vs {len(want)}"
    else:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        if bad:
            cells = sum(1 for g, w in bad for a, b in zip(g, w) if a != b)
            names = {got_cols[i] for g, w in bad for i, (a, b) in enumerate(zip(g, w)) if a != b}
            problem = f"{len(bad)} of {len(got)} rows differ ({cells} cells in {sorted(names)[:6]}), first: {bad[0]}"
    return problem, len(got), t1 - t0, t2 - t1


def main(argv):
    import __spark_entry__ as entry
    from chronopanel.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("local[8]", "oracle", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            if name in sqls:
                problem, n, ts, td = compare(con, spark, build, sqls[name], sf_dir)
            else:
                t0 = time.time()
                n = len(build(spark, sf_dir).collect())
                problem, ts, td = (None if n else "no rows"), time.time() - t0, 0.0
        except Exception as exc:
            problem, n, ts, td = f"{type(exc).__name__}: {str(exc)[:900]}", 0, 0, 0
        failed += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:28s} {n:8d} rows spark {ts:6.2f}s sql {td:6.2f}s {problem or ''}"[:1500], flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
