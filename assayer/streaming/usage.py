"""Windows over run events, quota log and requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from assayer import rules
from assayer.operators import runs
from assayer.sources import tables


def with_event_time(stream: DataFrame, column: str = "ts", delay: str = rules.WATERMARK) -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def quiet_runs(events: DataFrame, gap: str = f"{rules.STALE_MINUTES} minutes") -> DataFrame:
    """Activity sessions of runs; a session that closes without an end event went stale."""
    ended = F.bool_or(F.col("event").isin("done", "error"))
    return (
        with_event_time(events)
        .groupBy("run_id", F.session_window("ts", gap).alias("w"))
        .agg(ended.alias("ended"), F.count("*").alias("events"))
        .select("run_id", F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "ended", "events")
    )


def daily_usage(log: DataFrame) -> DataFrame:
    return runs.daily_usage(with_event_time(log, "created_at"))


def rate_report(requests: DataFrame, limit: int = rules.REQUESTS_PER_MINUTE) -> DataFrame:
    return runs.rate_report(with_event_time(requests), limit)


def reservation_outcomes(
    reserved: DataFrame, ended: DataFrame, ttl_minutes: int = rules.RESERVATION_TTL_MINUTES
) -> DataFrame:
    """Reservations with the first commit or release that followed in time, else expired.

    A left outer interval join gives every ending of a reservation, and an aggregate over the
    reservation keeps the first by event time: a committed unit is never released again.  State
    is bounded by the lifetime of a reservation; a row is emitted once the watermark has passed
    that lifetime.
    """
    left = with_event_time(reserved.select("analysis_id", F.col("ts").alias("reserved_at")), "reserved_at")
    right = with_event_time(
        ended.select(F.col("analysis_id").alias("ended_id"), F.col("ts").alias("ended_at"), "state"),
        "ended_at",
    )
    in_time = F.expr(
        "analysis_id = ended_id AND ended_at >= reserved_at "
        f"AND ended_at <= reserved_at + INTERVAL {ttl_minutes} MINUTES"
    )
    joined = left.join(right, in_time, "leftOuter")
    first = F.min(F.when(F.col("ended_at").isNotNull(), F.struct("ended_at", "state"))).alias("first")
    return joined.groupBy("analysis_id", "reserved_at").agg(first).select(
        "analysis_id", "reserved_at", F.col("first.ended_at").alias("ended_at"),
        F.coalesce("first.state", F.lit("expired")).alias("outcome"),
    )


def sweep(
    stream: DataFrame, log_path: str, report: Callable[[int, int], None] | None = None
) -> DataStreamWriter:
    """Sweep the stored log at ``log_path`` with every micro-batch of log rows as the clock.

    The time of a batch is its newest event, so a replay sweeps the same rows and then finds
    none.  ``report`` gets the number of reclaimed reservations and the batch id.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("created_at")).first()[0]
        if now is not None:
            n = tables.sweep_log(batch.sparkSession, log_path, F.lit(now))
            if report is not None:
                report(n, batch_id)

    return stream.writeStream.foreachBatch(handle).trigger(
        processingTime=f"{rules.SWEEP_SECONDS} seconds"
    )
