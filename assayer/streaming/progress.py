"""Progress events of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduce_progress(events: DataFrame) -> DataFrame:
    """State per run; the same aggregate serves a batch and an update-mode stream.

    ``events``: ``(run_id, ts, seq, event, step, message)``.  Progress without a step is
    ignored; ``done`` and ``error`` end the run.
    """
    at = F.struct("ts", "seq")
    event = F.col("event")
    stepping = (event == "progress") & (F.coalesce("step", F.lit("")) != "")
    ending = event.isin("done", "error")
    step = F.when(event == "done", F.lit("done")).when(stepping, F.col("step"))

    def last(value, condition):
        return F.max_by(F.when(condition, value), F.when(condition, at))

    return events.groupBy("run_id").agg(
        F.coalesce(last(step, stepping | (event == "done")), F.lit("fetching")).alias("current_step"),
        last(F.col("message"), stepping).alias("last_message"),
        F.coalesce(last(event, ending), F.lit("streaming")).alias("phase"),
        last(F.col("message"), event == "error").alias("error"),
        F.count_if(event == "step_complete").alias("steps_completed"),
    )


def step_results(events: DataFrame) -> DataFrame:
    """The last result per run and step."""
    return (
        events.filter(F.col("event") == "step_complete")
        .groupBy("run_id", "step")
        .agg(F.max_by("result", F.struct("ts", "seq")).alias("result"))
    )
