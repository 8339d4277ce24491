"""Compare registered queries with their SQL statements run by DuckDB on the same files."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "~null"
        return f"{v:.6f}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {got_cols} / {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return f"row counts differ: {len(got)} / {len(want)}; only here {extra}; only oracle {lack}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; first {bad[0]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from docketlake.session import build_session

    folder = "/root/testdata/sf" + sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failures = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.count() >= 0 else "?"
            n = ""
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        took = time.time() - start
        if problem:
            failures += 1
        print(f"{'FAIL' if problem else ('ok  ' if name in oracles else 'rows')} {name} {took:.1f}s {problem or ''}", flush=True)
    print("failures:", failures)
