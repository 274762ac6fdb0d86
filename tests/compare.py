"""Run registered queries beside their SQL and compare whole results.

python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def difference(spark, con, name, sf_dir):
    """'' when both sides agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {str(got[:2])[:600]} / {str(want[:2])[:600]}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference: {str(g)[:900]} / {str(w)[:900]}"
    return "" if got else "no rows on either side"


def session(cpus=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("newsloom-check")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, con, bad = session(), duck(sf), 0
    for n in args or sorted(entry.queries()):
        start = time.time()
        try:
            diff = difference(spark, con, n, sf)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(diff)
        print(f"{'ok ' if not diff else 'BAD'} {n} {time.time() - start:.1f}s "
              f"{'' if n in entry.oracle_sql() else '(rows only)'} {diff}", flush=True)
    print(f"{bad} bad")
