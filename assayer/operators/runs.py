"""Run history, ownership, admission, quota and reservations.  Every clock is an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import text as T

IN_PROGRESS_SCAN = ["scanning", "processing"]
VIEWABLE = ["scanned", "completed"]
RUNNING = ["pending", "scanning", "analyzing", "processing"]
RESERVED, COMMITTED, RELEASED = "reserved", "committed", "released"


def minutes(n: int) -> Column:
    return F.lit(dt.timedelta(minutes=n))


# --- runs ---------------------------------------------------------------------------------


def owned_by(df: DataFrame, user: Column | str) -> DataFrame:
    return df.filter(F.col("user_id") == user)


def is_stale(as_of: Column, stale_minutes: int = rules.STALE_MINUTES) -> Column:
    started = F.coalesce("phase_started_at", "created_at")
    return started < as_of - minutes(stale_minutes)


def stale_runs(runs: DataFrame, as_of: Column, stale_minutes: int = rules.STALE_MINUTES) -> DataFrame:
    busy = F.col("status").isin(*IN_PROGRESS_SCAN, "analyzing")
    return runs.filter(busy & is_stale(as_of, stale_minutes))


def admission(
    runs: DataFrame, as_of: Column, phase: str, stale_minutes: int = rules.STALE_MINUTES
) -> DataFrame:
    """May a phase start?  ``allowed`` and, where it may not, a stable ``code``."""
    status, stale = F.col("status"), is_stale(as_of, stale_minutes)
    none = F.lit(None).cast("string")
    if phase == "scan":
        busy = status.isin(IN_PROGRESS_SCAN)
        code = (
            F.when((status == "pending") | (busy & stale), none)
            .when(busy, F.lit("analysis_running"))
            .otherwise(F.lit("analysis_finished"))
        )
    else:
        busy = status == "analyzing"
        code = (
            F.when((status == "scanned") | (busy & stale), none)
            .when(busy, F.lit("analysis_running"))
            .when(status == "completed", F.lit("analysis_finished"))
            .otherwise(F.lit("scan_required"))
        )
    return runs.withColumn("code", code).withColumn("allowed", F.col("code").isNull())


def status_flags(runs: DataFrame) -> DataFrame:
    status = F.col("status")
    return runs.withColumns(
        {
            "viewable": status.isin(VIEWABLE),
            "running": status.isin(RUNNING),
            "can_deepen": status == "scanned",
            "deepened": status == "completed",
        }
    )


def history(runs: DataFrame) -> DataFrame:
    """Newest first per user, id as tie-break; a range-partitioned sort."""
    return runs.orderBy("user_id", F.desc("created_at"), F.desc("id"))


def latest_report(runs: DataFrame) -> DataFrame:
    """The newest viewable run of each user; an aggregate, so hot users fold on the map side."""
    rest = [c for c in runs.columns if c != "user_id"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id"))
    return (
        runs.filter(F.col("status").isin(VIEWABLE))
        .groupBy("user_id")
        .agg(newest.alias("run"))
        .select("user_id", "run.*")
    )


def run_details(runs: DataFrame, results: DataFrame) -> DataFrame:
    found = results.withColumnsRenamed({"status": "result_status"})
    return runs.join(found, runs["id"] == found["analysis_id"], "left").drop("analysis_id")


def results_by_aspect(results: DataFrame) -> DataFrame:
    """Map of aspect to status per run; the last row of an aspect wins, aspects are few."""
    last = results.groupBy("analysis_id", "aspect").agg(F.max_by("status", "ord").alias("status"))
    return last.groupBy("analysis_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("aspect", "status")))).alias("by_aspect")
    )


# --- catalog of repositories --------------------------------------------------------------


def filter_repos(
    repos: DataFrame, visibility: str | None = None, language: str | None = None, search: str = ""
) -> DataFrame:
    needle = search.strip().lower()
    if visibility:
        repos = repos.filter(F.col("visibility") == visibility)
    if language:
        repos = repos.filter(F.col("language") == language)
    if needle:
        repos = repos.filter(F.contains(F.lower("name"), F.lit(needle)))
    return repos


def language_facets(repos: DataFrame) -> DataFrame:
    return repos.filter(F.coalesce("language", F.lit("")) != "").select("language").distinct().orderBy("language")


# --- users --------------------------------------------------------------------------------


def upsert_users(dim: DataFrame, updates: DataFrame) -> DataFrame:
    """Profile columns follow the update, ``created_at`` stays; the name falls back to the login.

    ``updates``: ``(github_id, login, name, avatar_url, email, seen_at)``; of several updates of
    one user the last by ``seen_at`` counts.
    """
    fields = ["login", "username", "avatar_url", "email"]
    shown = F.coalesce(F.nullif("name", F.lit("")), "login")
    last = (
        updates.withColumn("username", shown)
        .groupBy("github_id")
        .agg(F.max_by(F.struct(*fields, "seen_at"), "seen_at").alias("new"))
    )
    old = dim.select("github_id", F.struct(*fields, "created_at").alias("old"))
    changed = F.col("new").isNotNull()
    return old.join(last, "github_id", "full").select(
        "github_id",
        *[F.when(changed, F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")).alias(f) for f in fields],
        F.coalesce("old.created_at", "new.seen_at").alias("created_at"),
        F.when(F.col("old").isNull(), F.lit("inserted"))
        .when(changed, F.lit("updated"))
        .otherwise(F.lit("kept"))
        .alias("change"),
    )


def purge_users(
    users: DataFrame, runs: DataFrame, results: DataFrame, purged: DataFrame
) -> dict[str, DataFrame]:
    """Remaining rows of the three tables, and rows removed per purged user."""
    ids = purged.select("user_id").distinct()
    gone_runs = runs.join(ids, "user_id", "left_semi").select("user_id", F.col("id").alias("analysis_id"))
    per_run = results.groupBy("analysis_id").agg(F.count("*").alias("n"))
    removed = (
        ids.join(gone_runs.join(per_run, "analysis_id", "left"), "user_id", "left")
        .groupBy("user_id")
        .agg(
            F.count("analysis_id").alias("runs_removed"),
            F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("results_removed"),
        )
    )
    return {
        "users": users.join(ids, "user_id", "left_anti"),
        "runs": runs.join(ids, "user_id", "left_anti"),
        "results": results.join(gone_runs.select("analysis_id"), "analysis_id", "left_anti"),
        "removed": removed,
    }


# --- quota and reservations ---------------------------------------------------------------


def is_live(as_of: Column) -> Column:
    return (F.col("state") == RESERVED) & (F.col("expires_at") > as_of)


def quota(log: DataFrame, as_of: Column, limit: int = rules.DAILY_LIMIT) -> DataFrame:
    """Units used today per user: committed ones and live reservations."""
    counts = (F.col("state") == COMMITTED) | is_live(as_of)
    used = (
        log.filter(F.col("created_at") >= T.start_of_day(as_of))
        .groupBy("github_id")
        .agg(F.count_if(counts).alias("used"))
    )
    return used.select(
        "github_id",
        "used",
        F.lit(limit).alias("limit"),
        F.greatest(F.lit(limit) - F.col("used"), F.lit(0).cast("long")).alias("remaining"),
    )


def daily_usage(log: DataFrame) -> DataFrame:
    """Committed units per user and calendar day."""
    return (
        log.filter(F.col("state") == COMMITTED)
        .groupBy("github_id", F.window("created_at", "1 day").alias("w"))
        .agg(F.count("*").alias("used"))
        .select("github_id", F.col("w.start").alias("day"), "used")
    )


def reservation_outcomes(log: DataFrame, ttl_minutes: int = rules.RESERVATION_TTL_MINUTES) -> DataFrame:
    """What became of each reservation: committed, released or expired.

    ``log``: ``(key, event_id, ts, state)``.  The first commit or release of the key after the
    reservation and within its lifetime decides; a later release cannot undo a commit.

    Keys are cut into time buckets one lifetime long, so the deciding event lies in the same
    bucket or is the first of the next one: a busy key becomes many groups, and no pairs of
    events are formed.
    """
    ttl = ttl_minutes * 60
    terminal = F.col("state") != RESERVED
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = log.withColumn("bucket", F.floor(seconds / F.lit(ttl * 1_000_000)).cast("long"))
    ending = F.when(terminal, F.struct("ts", "event_id", "state"))
    later_first = (
        Window.partitionBy("key", "bucket")
        .orderBy(F.desc("ts"), F.desc("event_id"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = cut.withColumn("same", F.last(ending, ignorenulls=True).over(later_first)).filter(~terminal)
    heads = cut.filter(terminal).groupBy("key", (F.col("bucket") - 1).alias("bucket")).agg(
        F.min(F.struct("ts", "event_id", "state")).alias("next")
    )
    decided = F.coalesce("same", "next")
    in_time = decided["ts"] <= F.col("ts") + minutes(ttl_minutes)
    return (
        inside.join(heads, ["key", "bucket"], "left")
        .withColumn("end", F.when(in_time, decided))
        .select(
            "key",
            "event_id",
            F.coalesce("end.state", F.lit("expired")).alias("outcome"),
            F.coalesce("end.ts", F.col("ts") + minutes(ttl_minutes)).alias("ended_at"),
        )
    )


def sweep_expired(log: DataFrame, as_of: Column) -> DataFrame:
    """Rows that stay; expired reservations go, committed rows are never touched."""
    return log.filter(~is_expired(as_of))


def is_expired(as_of: Column) -> Column:
    return F.coalesce((F.col("state") == RESERVED) & (F.col("expires_at") <= as_of), F.lit(False))


def reclaimed(log: DataFrame, as_of: Column) -> DataFrame:
    return log.agg(
        F.count_if(is_expired(as_of)).alias("reclaimed"),
        F.count_if(~is_expired(as_of)).alias("remaining"),
    )


def admit_under_limit(requests: DataFrame, limit: int = rules.DAILY_LIMIT) -> DataFrame:
    """The first ``limit`` requests per user and day are accepted, in order of arrival.

    Ranking stops below the shuffle at ``limit`` rows per user and task; the flag returns to
    the requests over their unique id, which no hot user can skew.
    """
    day = F.to_date("ts")
    order = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    accepted = (
        requests.select("user_id", "event_id", "ts", day.alias("day"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .select("event_id", F.lit(True).alias("hit"))
    )
    return requests.join(accepted, "event_id", "left").withColumn(
        "accepted", F.coalesce("hit", F.lit(False))
    ).drop("hit")


def rate_report(
    requests: DataFrame, limit: int = rules.REQUESTS_PER_MINUTE, period: str = "1 minute"
) -> DataFrame:
    """Keys and minutes above the allowed request rate."""
    return (
        requests.groupBy("key", F.window("ts", period).alias("w"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select("key", F.col("w.start").alias("minute"), "requests")
    )
