"""Run registered queries on Spark and their SQL on DuckDB, compare rows.

usage: python scripts/check.py FOLDER [name ...]      (names may end in * )
"""

from __future__ import annotations

import fnmatch
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgermatch.plans import catalog  # noqa: E402
from ledgermatch.plans.model import TABLES  # noqa: E402
from ledgermatch.session import build_session  # noqa: E402


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(round(v, 6) + 0.0)
        return str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:] or ["*"]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="check-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, sql, bad = catalog.queries(), catalog.oracle_sql(), 0
    for name, fn in queries.items():
        if not any(fnmatch.fnmatch(name, w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got = canonical([tuple(r) for r in df.collect()], df.columns)
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(sql[name])
            columns = [d[0] for d in cur.description]
            want = canonical(cur.fetchall(), columns)
            same = sorted(df.columns) == sorted(columns) and got == want
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got)} rows, {took:.1f}s (sql {time.time() - start:.1f}s)", flush=True)
            if not same:
                print("   spark", df.dtypes, "\n   sql  ", [(d[0], str(d[1])) for d in cur.description])
                a, b = set(got), set(want)
                print("   rows", len(got), len(want), "\n   only spark", sorted(a - b)[:3], "\n   only sql  ", sorted(b - a)[:3], flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
