"""Compares a query with its SQL on the same tables."""

import sys

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    return str(v)


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in rows])


def compare(spark, sf_dir, name, query, sql, con=None):
    con = con or connect(sf_dir)
    got = query(spark, sf_dir)
    rel = con.sql(sql)
    a, b = rows_of([tuple(r) for r in got.collect()], got.columns), rows_of(rel.fetchall(), rel.columns)
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} and {sorted(rel.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[0]}"[:700] if bad else None


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connect(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or [n for n in qs if not n.startswith("op") and n != "pipeline"]:
        t = time.time()
        try:
            said = compare(session, sf, n, qs[n], sqls[n], con) if n in sqls else f"(rows only: {qs[n](session, sf).count()})"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:900]}"
        print(f"{n}: {said or 'ok'} [{time.time() - t:.1f}s]", flush=True)
