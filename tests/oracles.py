"""Run every query with SQL at a scale and compare: python tests/oracles.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{x:.5f}" if isinstance(x, float) and x == x else "" if x is None or x != x else str(x) for x in r) for r in frame.itertuples(index=False))


def differences(spark, connection, query, sql, sf_dir):
    began = time.time()
    expected = connection.sql(sql).df()
    print(f"     SQL {time.time() - began:.1f}")
    got = query(spark, sf_dir).toPandas()
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} {sorted(expected.columns)}"
    a, b = rows(got), rows(expected)
    return None if a == b else f"{len(a)} and {len(b)} rows; only in Spark {sorted(set(a) - set(b))[:3]}, only in SQL {sorted(set(b) - set(a))[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, connection = __spark_entry__.queries(), duck(sys.argv[1])
    for name, sql in __spark_entry__.oracle_sql().items():
        if not sys.argv[2:] or name in sys.argv[2:]:
            began = time.time()
            try:
                wrong = differences(session, connection, queries[name], sql, sys.argv[1])
            except Exception as error:  # noqa: BLE001
                wrong = f"{type(error).__name__}: {str(error)[:600]}"
            print("ok  " if not wrong else "BAD ", name, f"{time.time() - began:.1f}", wrong or "", flush=True)
