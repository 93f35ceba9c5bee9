"""Usage report over the reservation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.operators import runs


def usage_report(log: DataFrame, as_of: Column, limit: int = rules.DAILY_LIMIT) -> DataFrame:
    """Per user: units used today, remaining, and live, expired and committed rows overall."""
    today = runs.quota(log, as_of, limit)
    states = log.groupBy("github_id").agg(
        F.count_if(F.col("state") == runs.COMMITTED).alias("committed"),
        F.count_if(runs.is_live(as_of)).alias("live"),
        F.count_if(runs.is_expired(as_of)).alias("expired"),
    )
    zero = F.lit(0).cast("long")
    return states.join(today.select("github_id", "used", "remaining"), "github_id", "left").select(
        "github_id",
        "committed",
        "live",
        "expired",
        F.coalesce("used", zero).alias("used"),
        F.coalesce("remaining", F.lit(limit).cast("long")).alias("remaining"),
    )
