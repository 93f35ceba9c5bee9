"""Admission under a daily limit as requests arrive, each decided once.

Decisions and counters are stored by day and batch.  A batch reads the counters of its days alone, ranks its
own requests by event time, and overwrites its own folders: replayed, after a lost driver or from the start,
it sees the counters of the batches before it and writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from assayer import rules
from assayer.session import materialize

DECISION = "user_id bigint, event_id bigint, ts timestamp, accepted boolean, day date, source string, batch bigint"
COUNTER = "user_id bigint, used bigint, day date, source string, batch bigint"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Every request that was decided."""
    return _stored(spark, f"{path}/decisions", DECISION)


def used_before(spark: SparkSession, path: str, source: str, batch: int) -> DataFrame:
    """``user_id, day, used`` by the batches of ``source`` before this one, and by all other sources."""
    counters = _stored(spark, f"{path}/counters", COUNTER)
    earlier = counters.filter((F.col("source") != source) | (F.col("batch") < batch))
    return earlier.groupBy("user_id", "day").agg(F.sum("used").alias("used"))


def admit_batch(
    requests: DataFrame, batch: int, path: str, limit: int = rules.DAILY_LIMIT, source: str = "requests"
) -> None:
    """Decide ``(user_id, event_id, ts)`` rows: accepted while the user's day has units left.

    The order within a batch is that of event time, then of ids.  A hot user sends at most
    ``limit`` candidates per task; the flags return over the unique id.
    """
    spark = requests.sparkSession
    rows = materialize(
        requests.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("day", F.to_date("ts")),
        "requests",
    )
    days = [r["day"] for r in rows.select("day").distinct().collect()]  # those of one batch
    if not days:
        return
    used = used_before(spark, path, source, batch).filter(F.col("day").isin(days))
    order = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    taken = first.join(used, ["user_id", "day"], "left").filter(F.col("place") + F.coalesce("used", F.lit(0)) <= limit)
    taken = materialize(taken.select("user_id", "event_id", "day"), "taken")
    flagged = rows.join(taken.select("event_id", F.lit(True).alias("hit")), "event_id", "left")
    named = {"source": F.lit(source), "batch": F.lit(batch).cast("bigint")}
    decided = flagged.select("user_id", "event_id", "ts", F.coalesce("hit", F.lit(False)).alias("accepted"), "day").withColumns(named)
    counted = taken.groupBy("user_id", "day").agg(F.count("*").alias("used")).select("user_id", "used", "day").withColumns(named)
    # a day without any accepted request has a counter too, so a replay overwrites what was there
    none = spark.createDataFrame([(None, 0, day) for day in days], "user_id bigint, used bigint, day date").withColumns(named)
    for frame, name in ((decided, "decisions"), (counted.unionByName(none), "counters")):
        (
            frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "source", "batch").parquet(f"{path}/{name}")
        )


def admit_requests(
    stream: DataFrame, path: str, limit: int = rules.DAILY_LIMIT, source: str = "requests"
) -> DataStreamWriter:
    """Every micro-batch of requests decided under its own number; ``source`` names the stream."""
    return stream.writeStream.foreachBatch(lambda rows, batch: admit_batch(rows, batch, path, limit, source))
