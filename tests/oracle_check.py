"""Compare queries with their SQL twins: python tests/oracle_check.py [sf_dir] [query ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


def compare(spark_df, con, sql):
    """None if equal, else what differs."""
    got = normal([tuple(r) for r in spark_df.collect()], spark_df.columns)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    kinds = dict(zip(columns, (str(d[1]) for d in found.description)))
    want = normal(found.fetchall(), columns)
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(columns)}"
    names = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(c, t, kinds[c]) for c, t in spark_df.dtypes if names.get(t) != kinds[c]]
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}" if wrong else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from workload.oracle import ORACLE
    from workload.queries import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                result = compare(df, con, ORACLE[name]) or f"ok, {df.count()} rows"
            else:
                result = f"rows only: {df.count()}"
        except Exception as e:
            result = f"ERROR {type(e).__name__} {str(e)[:700]}"
        print(f"{name:22s} {time.time() - began:6.1f}s  {result}", flush=True)
