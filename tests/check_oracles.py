"""Run registered queries next to their check SQL and compare whole results.

    python tests/check_oracles.py sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, float):
        return repr(round(value, 6))
    return repr(int(value)) if isinstance(value, int) else repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, sql):
    """(problem or '', spark rows, spark seconds, sql seconds)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want = res.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", len(got), t1 - t0, t2 - t1
    a, b = table(df.columns, got), table(columns, want)
    if a == b:
        return "", len(got), t1 - t0, t2 - t1
    left, right = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} vs {len(b)}, {len(set(a) - set(b))} differ\n   spark {left}\n   sql   {right}", len(got), t1 - t0, t2 - t1


def main() -> None:
    from folioflow.plans.oracles import ORACLES
    from folioflow.plans.queries import QUERIES
    from folioflow.session import local_session

    sf_dir, names = str(DATA / sys.argv[1]), sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if names and name not in names:
            continue
        if name not in ORACLES:
            print(f"--   {name}: no SQL", flush=True)
            continue
        try:
            problem, rows, s1, s2 = compare(spark, con, sf_dir, name, query, ORACLES[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, rows, s1, s2 = f"{type(error).__name__}: {str(error)[:700]}", 0, 0, 0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name}: {rows} rows, spark {s1:.1f}s, sql {s2:.1f}s {problem}", flush=True)
    print("failures:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
