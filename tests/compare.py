"""Compare registered queries with their SQL twins: ``python -m tests.compare [sf] [name …]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def differences(df: DataFrame, con, sql: str) -> list[str]:
    left_columns, left = spark_rows(df)
    right_columns, right = sql_rows(con, sql)
    if left_columns != right_columns:
        return [f"columns {left_columns} vs {right_columns}"]
    if left == right:
        return [] if left else ["both sides are empty"]
    left_set, right_set = set(left), set(right)
    only_left = [r for r in left if r not in right_set][:3]
    only_right = [r for r in right if r not in left_set][:3]
    return [f"rows {len(left)} vs {len(right)}", f"spark only {only_left}", f"sql only {only_right}"]


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = oracle_connection(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                problems = differences(fn(spark, sf_dir), con, sqls[name])
                note = "ok" if not problems else "DIFF " + " | ".join(problems)
            else:
                problems, note = [], f"rows {fn(spark, sf_dir).count()} (no SQL)"
        except Exception as error:  # noqa: BLE001
            problems, note = [error], f"ERROR {type(error).__name__}: {str(error)[:700]}"
        failed += bool(problems)
        print(f"{name:32s} {time.time() - start:6.2f}s {note[:1500]}", flush=True)
    print(f"{failed} problem(s)")


if __name__ == "__main__":
    main()
