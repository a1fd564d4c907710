"""Compare every registered query with its SQL twin; also a command line tool."""

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def run_sql(sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.execute(sql).df()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        key = []
        for v in row:
            if pd.isna(v):
                key.append(None)
            elif isinstance(v, float):
                key.append(round(v, 6) + 0.0)
            elif hasattr(v, "item"):
                key.append(v.item())
            else:
                key.append(v)
        out.append(tuple(key))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def difference(got, want):
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        only = list(set(a) - set(b))[:2], list(set(b) - set(a))[:2]
        return f"{len(a)} rows vs {len(b)}; {str(only)[:600]}"
    bad = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry_points

    sf_dir = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            start = time.time()
            result = "rows only" if name not in oracle else difference(got, run_sql(oracle[name], sf_dir)) or "ok"
            print(f"{name}: {len(got)} rows {spent:.1f}s sql {time.time() - start:.1f}s {result}", flush=True)
        except Exception as e:
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:500]}", flush=True)
