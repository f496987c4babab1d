"""python tests/verify.py [SF_DIR] [NAME...]: run queries beside their SQL and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_module  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, sf_dir: str, name: str) -> str:
    began = time.time()
    df = entry_module.queries()[name](spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got_rows)} ({took:.1f} s)"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want_rows = [tuple(dict(v) if isinstance(v, dict) else v for v in r) for r in res.fetchall()]
    if sorted(columns) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = rows_of(df.columns, got_rows), rows_of(columns, [tuple(tuple(v.values()) if isinstance(v, dict) else v for v in r) for r in want_rows])
    if got != want:
        return f"FAIL {len(got_rows)} rows, {len(want_rows)} expected; only here {list((got - want).items())[:2]}; missing {list((want - got).items())[:2]}"
    types = [(str(t), c) for c, t in sorted(zip(columns, [d[1] for d in res.description], strict=True))]
    return f"ok {len(got_rows)} ({took:.1f} s) {dict(df.dtypes)} {types}" if "-t" in sys.argv else f"ok {len(got_rows)} ({took:.1f} s)"


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-t"]
    sf = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a] or list(entry_module.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        try:
            said = compare(spark, sf, n)
        except Exception as e:
            said = f"FAIL {type(e).__name__} {str(e)[:700]}"
        bad += said.startswith("FAIL")
        print(n, said, flush=True)
    print("failures:", bad)
