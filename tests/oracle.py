"""Compares registered queries with their SQL: ``python tests/oracle.py SF_DIR [NAME...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, query, statement):
    """None if equal, else what differs."""
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(statement).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    cols = sorted(ours.columns)
    null = lambda v: v is None or v != v
    rows = lambda d: sorted([tuple("\0" if null(v) else str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False)])
    a, b = rows(ours), rows(theirs)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ: {str(bad[0])[:400]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, statements = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names or (not names and (name.startswith("op") or name == "pipeline")):
            continue
        began = time.time()
        try:
            said = compare(spark, con, sf_dir, query, statements[name]) if name in statements else f"no SQL; {query(spark, sf_dir).count()} rows"
        except Exception as e:
            said = f"error {str(e)[:300]}"
        print(name, round(time.time() - began, 1), said or "equal", flush=True)
