"""Run registered queries beside their checking SQL: ``python -m tests.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from __spark_entry__ import oracle_sql, queries
from lodespark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return v
    return repr(float(v)) if isinstance(v, int) else v


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float, float]:
    """Verdict, rows, seconds in Spark and in the checking engine."""
    start = time.time()
    df = queries()[name](spark, sf_dir)
    got = df.collect()
    spark_s = time.time() - start
    text = oracle_sql().get(name)
    if text is None:
        return ("rows only" if got else "EMPTY"), len(got), spark_s, 0.0
    start = time.time()
    cur = con.execute(text)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_s = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} {sorted(columns)}", len(got), spark_s, duck_s
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return "equal", len(got), spark_s, duck_s
    return f"DIFF {len(got)} {len(want)} {list((a - b).items())[:2]} {list((b - a).items())[:2]}", len(got), spark_s, duck_s


if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(queries())
    session, con = local_session(), connection(sys.argv[1])
    session.sparkContext.setLogLevel("ERROR")
    for n in names:
        try:
            verdict, count, s, d = compare(session, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001
            verdict, count, s, d = f"ERROR {type(e).__name__} {str(e)[:600]}", 0, 0.0, 0.0
        print(f"{n:32s} {count:7d} {s:6.1f}s {d:6.1f}s  {verdict}", flush=True)
