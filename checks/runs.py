"""Runs, quota, reservations, rates, progress; events stand in for the logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import runs as R
from assayer.plans.usage import usage_report as usage_plan
from assayer.session import new_table_path
from assayer.sources.answers import parse_events
from assayer.streaming import admission, progress
from checks.registry import query, table

AS_OF = "2024-01-15 12:00:00"
SQL_NOW = f"TIMESTAMP '{AS_OF}'"


def now():
    return F.lit(AS_OF).cast("timestamp")


STATES = ["pending", "scanning", "processing", "scanned", "analyzing", "completed", "failed"]


def run_rows(spark, sf_dir):
    """Every event as a run; phases of some never started."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.alias("id"), "user_id",
        F.element_at(F.array(*[F.lit(s) for s in STATES]), (n % 7).cast("int") + 1).alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(n % 3 != 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 3 DAYS")).alias("phase_started_at"),
    )


RUNS = f"""runs AS (SELECT event_id AS id, user_id, {STATES}[CAST(event_id % 7 AS INT) + 1] AS status, ts AS created_at, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 3 DAY END AS phase_started_at FROM events),
  aged AS (SELECT *, coalesce(phase_started_at, created_at) < {SQL_NOW} - INTERVAL 15 MINUTE AS stale FROM runs)"""


@query(f"WITH {RUNS} SELECT id FROM aged WHERE stale AND status IN ('scanning', 'processing', 'analyzing')")
def stale_runs(spark, sf_dir):
    return R.stale_runs(run_rows(spark, sf_dir), now()).select("id")


_SCAN = """CASE WHEN status = 'pending' OR (status IN ('scanning', 'processing') AND stale) THEN NULL
  WHEN status IN ('scanning', 'processing') THEN 'analysis_running' ELSE 'analysis_finished' END"""
_AI = """CASE WHEN status = 'scanned' OR (status = 'analyzing' AND stale) THEN NULL WHEN status = 'analyzing' THEN 'analysis_running'
  WHEN status = 'completed' THEN 'analysis_finished' ELSE 'scan_required' END"""


@query(f"WITH {RUNS} SELECT id, {_SCAN} AS scan_code, {_SCAN} IS NULL AS scan_allowed, {_AI} AS ai_code, {_AI} IS NULL AS ai_allowed FROM aged")
def admissions(spark, sf_dir):
    scan = R.admission(run_rows(spark, sf_dir), now(), "scan").withColumnsRenamed({"code": "scan_code", "allowed": "scan_allowed"})
    both = R.admission(scan, now(), "ai").withColumnsRenamed({"code": "ai_code", "allowed": "ai_allowed"})
    return both.select("id", "scan_code", "scan_allowed", "ai_code", "ai_allowed")


@query(
    f"""WITH {RUNS} SELECT id, status IN ('scanned', 'completed') AS viewable, status IN ('pending', 'scanning', 'analyzing', 'processing') AS running,
    status = 'scanned' AS can_deepen, status = 'completed' AS deepened FROM runs"""
)
def status_flags(spark, sf_dir):
    return R.status_flags(run_rows(spark, sf_dir)).select("id", "viewable", "running", "can_deepen", "deepened")


@query(f"WITH {RUNS} SELECT id, user_id, status FROM runs ORDER BY user_id, created_at DESC, id DESC")
def run_history(spark, sf_dir):
    return R.history(run_rows(spark, sf_dir)).select("id", "user_id", "status")


@query(f"WITH {RUNS} SELECT id, status FROM runs WHERE user_id = 7")
def owned_runs(spark, sf_dir):
    return R.owned_by(run_rows(spark, sf_dir), F.lit(7)).select("id", "status")


@query(f"WITH {RUNS} SELECT user_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM runs WHERE status IN ('scanned', 'completed')) WHERE rn = 1")
def latest_reports(spark, sf_dir):
    return R.latest_report(run_rows(spark, sf_dir)).select("user_id", "id", "status")


def result_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("analysis_id"),
        F.concat(F.lit("aspect"), (F.col("l_linenumber") % 4).cast("string")).alias("aspect"),
        F.col("l_returnflag").alias("status"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"),
    )


@query(
    """SELECT analysis_id, string_agg(concat(aspect, '=', status), ',' ORDER BY aspect) AS by_aspect FROM (
    SELECT l_orderkey AS analysis_id, concat('aspect', l_linenumber % 4) AS aspect, l_returnflag AS status,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 4 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem)
    WHERE rn = 1 GROUP BY analysis_id"""
)
def results_by_aspect(spark, sf_dir):
    grouped = R.results_by_aspect(result_rows(spark, sf_dir))
    shown = F.transform(F.map_entries("by_aspect"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return grouped.select("analysis_id", F.array_join(shown, ",").alias("by_aspect"))


@query("SELECT o_orderkey AS id, o_custkey AS user_id, 'aspect' || (l_linenumber % 4) AS aspect, l_returnflag AS result_status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def run_details(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    return R.run_details(orders, result_rows(spark, sf_dir).drop("ord")).select("id", "user_id", "aspect", "result_status")


# --- quota --------------------------------------------------------------------------------

TTL = 240


def quota_log(spark, sf_dir):
    """Clicks and views are reservations that live ``TTL`` minutes, all else committed units."""
    ts = F.col("ts").cast("timestamp")
    reserved = F.col("event_type").isin("click", "view")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("github_id"), F.col("event_id").alias("analysis_id"),
        F.when(reserved, F.lit("reserved")).otherwise(F.lit("committed")).alias("state"),
        F.when(reserved, ts + R.minutes(TTL)).alias("expires_at"),
        ts.alias("created_at"),
    )


LOG = f"""log AS (SELECT user_id AS github_id, event_id AS analysis_id, CASE WHEN event_type IN ('click', 'view') THEN 'reserved' ELSE 'committed' END AS state,
  CASE WHEN event_type IN ('click', 'view') THEN ts + INTERVAL {TTL} MINUTE END AS expires_at, ts AS created_at FROM events)"""
LIVE = f"(state = 'reserved' AND expires_at > {SQL_NOW})"
USED = f"""used AS (SELECT github_id, count(*) FILTER (WHERE state = 'committed' OR {LIVE}) AS used FROM log WHERE created_at >= date_trunc('day', {SQL_NOW}) GROUP BY github_id)"""


@query(f"WITH {LOG} SELECT analysis_id, {LIVE} AS live FROM log WHERE state = 'reserved'")
def live_reservations(spark, sf_dir):
    log = quota_log(spark, sf_dir).filter(F.col("state") == "reserved")
    return log.select("analysis_id", R.is_live(now()).alias("live"))


@query(f'WITH {LOG}, {USED} SELECT github_id, used, 3 AS "limit", greatest(3 - used, 0) AS remaining FROM used')
def quota(spark, sf_dir):
    return R.quota(quota_log(spark, sf_dir), now())


@query(f"WITH {LOG} SELECT github_id, strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, count(*) AS used FROM log WHERE state = 'committed' GROUP BY ALL")
def daily_usage(spark, sf_dir):
    return R.daily_usage(quota_log(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {LOG} SELECT analysis_id, state FROM log WHERE NOT (state = 'reserved' AND expires_at <= {SQL_NOW})")
def swept_log(spark, sf_dir):
    return R.sweep_expired(quota_log(spark, sf_dir), now()).select("analysis_id", "state")


@query(f"WITH {LOG} SELECT count(*) FILTER (WHERE state = 'reserved' AND expires_at <= {SQL_NOW}) AS reclaimed, count(*) FILTER (WHERE state = 'committed' OR expires_at > {SQL_NOW}) AS remaining FROM log")
def reclaimed_reservations(spark, sf_dir):
    return R.reclaimed(quota_log(spark, sf_dir), now())


@query(
    f"""WITH {LOG}, {USED} SELECT l.github_id, count(*) FILTER (WHERE state = 'committed') AS committed, count(*) FILTER (WHERE {LIVE}) AS live,
    count(*) FILTER (WHERE state = 'reserved' AND expires_at <= {SQL_NOW}) AS expired, coalesce(any_value(u.used), 0) AS used, greatest(3 - coalesce(any_value(u.used), 0), 0) AS remaining
    FROM log l LEFT JOIN used u USING (github_id) GROUP BY l.github_id"""
)
def usage_report(spark, sf_dir):
    return usage_plan(quota_log(spark, sf_dir), now())


def reservation_log(spark, sf_dir):
    state = F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'reserved' WHEN event_type = 'purchase' THEN 'committed' ELSE 'released' END")
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), state.alias("state"))


@query(
    f"""WITH ends AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'committed' ELSE 'released' END AS state FROM events WHERE event_type NOT IN ('click', 'view')),
    paired AS (SELECT r.event_id, r.user_id, r.ts, e.state, e.ts AS ended, row_number() OVER (PARTITION BY r.event_id ORDER BY e.ts, e.event_id) AS rn
      FROM events r LEFT JOIN ends e ON e.user_id = r.user_id AND (e.ts, e.event_id) > (r.ts, r.event_id) AND e.ts <= r.ts + INTERVAL {TTL} MINUTE WHERE r.event_type IN ('click', 'view'))
    SELECT user_id AS key, event_id, coalesce(state, 'expired') AS outcome, strftime(coalesce(ended, ts + INTERVAL {TTL} MINUTE), '%Y-%m-%d %H:%M:%S') AS ended_at FROM paired WHERE rn = 1"""
)
def reservation_outcomes(spark, sf_dir):
    outcomes = R.reservation_outcomes(reservation_log(spark, sf_dir), TTL)
    return outcomes.withColumn("ended_at", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def admitted_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return R.admit_under_limit(requests, 2).select("event_id", "accepted")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def admitted_in_batches(spark, sf_dir):
    """The same in three batches by time; the second is replayed, and then the last."""
    requests = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = requests.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    part = F.least(F.floor((micros - ends["a"]) * 3 / max(ends["b"] - ends["a"], 1)), F.lit(2))
    path = new_table_path(spark, "admission")
    for batch in (0, 1, 1, 2, 1, 2):
        admission.admit_batch(requests.filter(part == batch), batch, path, limit=2)
    return admission.decisions(spark, path).select("event_id", "accepted")


@query("SELECT event_type AS key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS minute, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 3")
def request_rates(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return R.rate_report(requests, 3, "1 hour").withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH"))


# --- progress -----------------------------------------------------------------------------


def event_lines(spark, sf_dir):
    """Events of every user's run as lines of an event stream, comments between them."""
    kind = F.expr("CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'step_complete' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'progress' ELSE 'done' END")
    step = F.when(F.col("event_type") == "purchase", F.lit(None)).otherwise(F.concat(F.lit("step"), (F.col("event_id") % 4).cast("string")))
    body = F.to_json(
        F.struct(kind.alias("event"), step.alias("step"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"), F.col("props").alias("result"))
    )
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit(": ping "), body)).otherwise(F.concat(F.lit("data: "), body))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), line.alias("line"))


PARSED = """parsed AS (SELECT user_id AS run_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'step_complete' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'progress' ELSE 'done' END AS event,
  CASE WHEN event_type <> 'purchase' THEN concat('step', event_id % 4) END AS step, concat('m', event_id) AS message, props AS result FROM events WHERE event_id % 10 <> 0)"""


@query(f"WITH {PARSED} SELECT run_id, seq, event, step, message, result FROM parsed")
def parsed_events(spark, sf_dir):
    return parse_events(event_lines(spark, sf_dir)).select("run_id", "seq", "event", "step", "message", "result")


def _last(value: str, condition: str) -> str:
    return f"arg_max({value}, concat(strftime(ts, '%Y%m%d%H%M%S%f'), lpad(CAST(seq AS VARCHAR), 12, '0'))) FILTER (WHERE {condition})"


@query(
    f"""WITH {PARSED} SELECT run_id, coalesce({_last("CASE WHEN event = 'done' THEN 'done' ELSE step END", "event = 'done' OR (event = 'progress' AND step IS NOT NULL)")}, 'fetching') AS current_step,
    {_last("message", "event = 'progress' AND step IS NOT NULL")} AS last_message, coalesce({_last("event", "event IN ('done', 'error')")}, 'streaming') AS phase,
    {_last("message", "event = 'error'")} AS error, count(*) FILTER (WHERE event = 'step_complete') AS steps_completed FROM parsed GROUP BY run_id"""
)
def run_progress(spark, sf_dir):
    return progress.reduce_progress(parse_events(event_lines(spark, sf_dir)))


@query(f"WITH {PARSED} SELECT run_id, step, {_last('result', 'TRUE')} AS result FROM parsed WHERE event = 'step_complete' GROUP BY run_id, step")
def step_results(spark, sf_dir):
    return progress.step_results(parse_events(event_lines(spark, sf_dir)))
