"""Tables of versions: rows are only ever added, readers take the first or the last of a key.

Every row carries when and by whom it was written, so two writers who saw the same state leave two rows
of which all readers take the same one, and nothing is rewritten.  Rows lie in bucket folders of their key.
The number of buckets belongs to the table; a reader who asks for keys reads their folders alone.  A row of
kind ``gone`` marks a deletion: what was written before it is not there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.session import small_side

ABOUT = "_versions.json"
BUCKETS = 256


@dataclass(frozen=True)
class VersionedTable:
    path: str
    schema: str  # of the rows as they are put
    keys: tuple[str, ...]
    part: str  # the key column that buckets go by
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.part), F.lit(self.buckets)).cast("int")


def _about(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{ABOUT}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def open_versions(
    spark: SparkSession, path: str, schema: str | None = None, keys: list[str] | None = None,
    part: str | None = None, buckets: int = BUCKETS,
) -> VersionedTable:
    """The table at ``path`` as it was made; one that is not there is made as said here."""
    system, at = _about(spark, path)
    if system.exists(at):
        stream = system.open(at)
        text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        about = json.loads(text)
        return VersionedTable(path, about["schema"], tuple(about["keys"]), about["part"], about["buckets"])
    table = VersionedTable(path, schema, tuple(keys), part or keys[0], int(buckets))
    out = system.create(at, False)
    named = {"schema": schema, "keys": list(keys), "part": table.part, "buckets": table.buckets}
    out.write(json.dumps(named).encode())
    out.close()
    return table


STAMP = "written_at timestamp, writer string, gone boolean"


def _columns(table: VersionedTable) -> list[str]:
    return StructType.fromDDL(table.schema).names


def _append(table: VersionedTable, rows: DataFrame, gone: bool) -> None:
    columns = [F.col(c).cast(f.dataType).alias(c) if c in rows.columns else F.lit(None).cast(f.dataType).alias(c)
               for c, f in ((f.name, f) for f in StructType.fromDDL(table.schema).fields)]
    stamped = rows.select(*columns).withColumns(
        {"written_at": F.current_timestamp(), "writer": F.lit(uuid.uuid4().hex), "gone": F.lit(gone)}
    )
    dealt = stamped.withColumn("bucket", table.bucket()).hint("rebalance", "bucket")
    dealt.write.mode("append").partitionBy("bucket").parquet(table.path)


def put(table: VersionedTable, rows: DataFrame) -> None:
    """Add a version of every row; only the folders of its keys get a file."""
    _append(table, rows, False)


def remove(table: VersionedTable, keys: DataFrame) -> None:
    """Mark all that is there of these values of the bucket column as gone."""
    _append(table, keys.select(table.part).distinct(), True)


def rows_of(spark: SparkSession, table: VersionedTable, asked: DataFrame | None = None) -> DataFrame:
    """All versions, of the keys ``asked`` (a frame with the bucket column) alone where it is given.

    At most ``buckets`` numbers go to the driver; as literals they prune the folders.
    """
    rows = spark.read.schema(f"{table.schema}, {STAMP}, bucket int").parquet(table.path)
    if asked is None:
        return rows
    touched = [r[0] for r in asked.select(table.bucket()).distinct().collect()]
    wanted = small_side(asked.select(table.part).distinct())
    return rows.filter(F.col("bucket").isin(touched)).join(wanted, table.part, "left_semi")


def current(spark: SparkSession, table: VersionedTable, asked: DataFrame | None = None, first: bool = False) -> DataFrame:
    """One row a key: the ``first`` version that still stands, or the last.

    Versions fold in their tasks, whatever their number.
    """
    rows = rows_of(spark, table, asked)
    when = F.struct("written_at", "writer")
    lost = rows.filter("gone").groupBy(table.part).agg(F.max("written_at").alias("lost_at"))
    stands = rows.filter(~F.col("gone")).join(lost, table.part, "left").filter(
        F.col("lost_at").isNull() | (F.col("written_at") > F.col("lost_at"))
    )
    others = [c for c in _columns(table) if c not in table.keys]
    pick = F.min_by if first else F.max_by
    found = stands.groupBy(*table.keys).agg(pick(F.struct(*others), when).alias("row"))
    return found.select(*[F.col(c) if c in table.keys else F.col("row")[c].alias(c) for c in _columns(table)])


def put_group(table: VersionedTable, rows: DataFrame, groups: DataFrame) -> None:
    """Replace all rows of ``groups`` (values of the bucket column): they are marked, then written.

    One job and one moment for both, so a reader sees the old rows or the new ones; running it again
    adds a version of the same rows.
    """
    fields = StructType.fromDDL(table.schema).fields
    marks = groups.select(table.part).distinct().select(
        *[F.col(f.name) if f.name == table.part else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    )
    both = marks.withColumn("gone", F.lit(True)).unionByName(rows.select(*[f.name for f in fields]).withColumn("gone", F.lit(False)))
    stamped = both.withColumns({"written_at": F.current_timestamp(), "writer": F.lit(uuid.uuid4().hex)})
    dealt = stamped.select(*[f.name for f in fields], "written_at", "writer", "gone").withColumn("bucket", table.bucket())
    dealt.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(table.path)


def newest_group(spark: SparkSession, table: VersionedTable, asked: DataFrame | None = None) -> DataFrame:
    """The rows of the last ``put_group`` of every value of the bucket column."""
    rows = rows_of(spark, table, asked)
    last = rows.filter("gone").groupBy(table.part).agg(F.max(F.struct("written_at", "writer")).alias("last"))
    kept = rows.filter(~F.col("gone")).join(last, table.part).filter(F.struct("written_at", "writer") == F.col("last"))
    return kept.select(*_columns(table))
