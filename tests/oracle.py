"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

import math
import os
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def compare(spark, sf_dir, query, sql):
    """None if alike, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted([plain(r[c]) for c in names] for r in df.collect())
    rel = views(sf_dir).sql(sql)
    cols = rel.columns
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    theirs = sorted([plain(dict(zip(cols, r))[c]) for c in names] for r in rel.fetchall())
    if mine == theirs:
        return None
    at = next((i for i, (a, b) in enumerate(zip(mine, theirs)) if a != b), min(len(mine), len(theirs)))
    return f"{len(mine)} rows against {len(theirs)}; first difference {mine[at : at + 2]} against {theirs[at : at + 2]}"


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    where = os.environ.get("SF", "/root/testdata/sf0.01")
    for name, query in e.queries().items():
        if any(name.startswith(p) for p in sys.argv[1:]) or not sys.argv[1:]:
            began = time.time()
            try:
                sql = e.oracle_sql().get(name)
                said = compare(s, where, query, sql) if sql else f"no SQL; {query(s, where).count()} rows"
            except Exception as x:
                said = "ERROR " + str(x)[:1500]
            print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
