"""Tables bucketed and sorted by their key, which joins on that key read without moving them.

The number of buckets and the key belong to the table: they are written beside it when it is made and
read back when it is opened, so every later job agrees on them.  Choose buckets of some hundred MB, and at
least as many as the session has shuffle partitions, or Spark deals both sides anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 256
ABOUT = "_bucketed.json"  # Spark's readers pass over names with an underscore


@dataclass(frozen=True)
class BucketedTable:
    """Where a table lies and how it is dealt out; ``name`` is its name in this session."""

    path: str
    keys: tuple[str, ...]
    buckets: int
    name: str

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{ABOUT}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _named(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> BucketedTable:
    name = f"bucketed_{uuid.uuid4().hex}"
    listed = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet "
        f"CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return BucketedTable(path, tuple(keys), buckets, name)


def create(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> BucketedTable:
    """A new, empty table of ``schema`` at ``path``."""
    table = _named(spark, path, schema, keys, int(buckets))
    system, at = _file(spark, path)
    out = system.create(at, False)
    out.write(json.dumps({"schema": schema, "keys": list(keys), "buckets": int(buckets)}).encode())
    out.close()
    return table


def open_table(spark: SparkSession, path: str) -> BucketedTable:
    """The table at ``path``, dealt out as it was made."""
    system, at = _file(spark, path)
    stream = system.open(at)
    about = json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    stream.close()
    return _named(spark, path, about["schema"], about["keys"], about["buckets"])


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _file(spark, path)
    return system.exists(at)


def append(table: BucketedTable, rows: DataFrame) -> None:
    """Add rows: one file a bucket and job, sorted by the key."""
    spark = rows.sparkSession
    columns = spark.table(table.name).columns
    dealt = rows.select(*columns).repartition(table.buckets, *table.keys).sortWithinPartitions(*table.keys)
    dealt.write.insertInto(table.name)
    spark.catalog.refreshTable(table.name)


def forget(spark: SparkSession, table: BucketedTable) -> None:
    """Drop the name in this session; the files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table.name}")
