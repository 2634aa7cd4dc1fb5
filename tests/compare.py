"""Run registered queries next to their SQL and compare rows, for tests and by hand.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return None if math.isnan(v) else round(v, 6)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows vs {sum(want.values())}; {sum(extra.values())} differ\n"
            f"    cols  {got_cols}\n    spark {list(extra)[:2]}\n    sql   {list(missing)[:2]}"
        )
    return None if got else "both empty"


def main() -> None:
    from sideline.plans.oracles import ORACLES
    from sideline.plans.queries import REGISTRY
    from sideline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = build_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, REGISTRY[name], ORACLES.get(name))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {time.time() - t0:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok; unregistered oracles: {sorted(set(ORACLES) - set(REGISTRY))}")


if __name__ == "__main__":
    main()
