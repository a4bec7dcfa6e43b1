"""Compare registered queries with their SQL: python tests/compare.py SF_DIR [query ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck_views(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    """Rows with columns in name order, floats to nine digits, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if hasattr(v, "as_tuple"):
            v = float(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return repr(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_result(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    cursor = con.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = duck_views(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = spark_result(query(spark, sf_dir))
        except Exception as error:  # report and go on with the others
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(got[1])} rows, {took:.2f} s", flush=True)
            continue
        want = duck_result(con, oracles[name])
        same = got == want
        print(f"{'ok  ' if same else 'DIFF'} {name}: {len(got[1])} rows, {took:.2f} s", flush=True)
        if not same:
            print("  columns", got[0], want[0], len(want[1]))
            a, b = set(got[1]), set(want[1])
            print("  only spark", sorted(a - b)[:3], "\n  only sql", sorted(b - a)[:3])


if __name__ == "__main__":
    main()
