"""Run queries on both engines and compare the rows.

    python -m verification.compare [SF_DIR] [NAME_PART …]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((type(_value(r[i])).__name__, str(_value(r[i]))) for i in order) for r in rows)


def differences(df, con, sql: str) -> tuple[int, int, str | None]:
    """(rows in Spark, rows in SQL, first difference or None)."""
    mine = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(mine), len(theirs), f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = _rows(df.columns, mine), _rows(names, theirs)
    if a != b:
        return len(mine), len(theirs), f"only Spark: {list((a - b).items())[:2]}\n      only SQL:   {list((b - a).items())[:2]}"
    return len(mine), len(theirs), None


def main() -> int:
    from fleetsift.plans.session import configure
    from verification.queries import ORACLE, QUERIES
    from verification.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    parts = args[1:]
    spark = configure(local_session("compare"))
    con = connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                mine, theirs, diff = differences(run(spark, sf_dir), con, ORACLE[name])
                state = "ok" if diff is None and mine else "EMPTY" if diff is None else "DIFF"
            else:
                mine, theirs, diff, state = run(spark, sf_dir).count(), -1, None, "rows"
        except Exception as error:  # noqa: BLE001
            mine = theirs = -1
            state, diff = "ERROR", str(error)[:1500]
        bad += state not in ("ok", "rows")
        print(f"{state:5} {name:40} spark={mine} sql={theirs} {time.time() - start:.1f}s", flush=True)
        if diff:
            print("      " + diff, flush=True)
    print(f"{bad} of {len(QUERIES)} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
