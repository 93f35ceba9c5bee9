"""Streams from files, run to the end, against the batch results on the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from assayer.sources import tables
from assayer.streaming import incremental, progress, usage

START = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def stream_of(spark, path, rows, schema):
    """One file per row group, so that later rows arrive in later batches."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(df, path, mode="append"):
    name = f"q{abs(hash(path))}"
    query = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_progress_in_update_mode(spark, tmp_path):
    schema = "run_id string, ts timestamp, seq long, event string, step string, message string, result string"
    rows = [
        ("a", at(0), 0, "progress", "fetching", "f", None),
        ("a", at(1), 1, "progress", None, "ignored", None),
        ("a", at(2), 2, "progress", "scanning", "s", None),
        ("b", at(0), 3, "progress", "fetching", "f", None),
        ("a", at(3), 4, "step_complete", "quality_check", None, "{}"),
        ("a", at(4), 5, "done", None, None, None),
        ("b", at(5), 6, "error", None, "broken", None),
    ]
    stream = stream_of(spark, str(tmp_path), [rows[:4], rows[4:]], schema)
    updates = run(progress.reduce_progress(stream), str(tmp_path), "update")
    last = {r["run_id"]: r.asDict() for r in updates}
    batch = {r["run_id"]: r.asDict() for r in progress.reduce_progress(spark.createDataFrame(rows, schema)).collect()}
    assert last == batch
    assert (batch["a"]["current_step"], batch["a"]["phase"], batch["a"]["last_message"]) == ("done", "done", "s")
    assert (batch["b"]["current_step"], batch["b"]["phase"], batch["b"]["error"]) == ("fetching", "error", "broken")


def test_reservations_expire(spark, tmp_path):
    left_schema, right_schema = "analysis_id string, ts timestamp", "analysis_id string, ts timestamp, state string"
    reserved = [[("a", at(0)), ("b", at(1)), ("c", at(2)), ("d", at(3))], [("late", at(300))], [("later", at(600))]]
    ended = [[("a", at(5), "committed"), ("a", at(6), "released"), ("b", at(21), "committed"), ("b", at(20), "released"), ("c", at(40), "committed")], [("z", at(300), "released")], [("z", at(600), "released")]]
    joined = usage.reservation_outcomes(
        stream_of(spark, f"{tmp_path}/l", reserved, left_schema), stream_of(spark, f"{tmp_path}/r", ended, right_schema)
    )
    rows = run(joined, str(tmp_path))
    outcome = {r["analysis_id"]: r["outcome"] for r in rows}
    assert len(rows) == len(outcome)  # one outcome each, whatever ended it later
    assert {k: outcome[k] for k in "abcd"} == {"a": "committed", "b": "released", "c": "expired", "d": "expired"}


def test_windows_close_after_the_watermark(spark, tmp_path):
    schema = "key string, ts timestamp"
    rows = [[("u", at(0.1 * i)) for i in range(8)] + [("v", at(0.5))], [("u", at(60))], [("u", at(120))]]
    report = usage.rate_report(stream_of(spark, f"{tmp_path}/rate", rows, schema), 5)
    assert [(r["key"], r["requests"]) for r in run(report, f"{tmp_path}/rate")] == [("u", 8)]
    events = [[("a", at(0), "progress"), ("b", at(1), "progress"), ("b", at(5), "done")], [("c", at(300), "progress")], [("c", at(600), "progress")]]
    quiet = usage.quiet_runs(stream_of(spark, f"{tmp_path}/quiet", events, "run_id string, ts timestamp, event string"))
    closed = {r["run_id"]: (r["ended"], r["events"]) for r in run(quiet, f"{tmp_path}/quiet") if r["run_id"] != "c"}
    assert closed == {"a": (False, 1), "b": (True, 2)}


def test_sweep_reclaims_from_the_stored_log(spark, tmp_path):
    """A reservation of the first batch expires two batches later, and one folder becomes empty."""
    schema = "analysis_id string, state string, expires_at timestamp, created_at timestamp"
    rows = [
        [("a", "reserved", at(20), at(0)), ("b", "committed", None, at(1)), ("c", "reserved", at(3000), at(2))],
        [("d", "reserved", at(2000), at(60))], [("e", "committed", None, at(3100))],
    ]
    log = f"{tmp_path}/log"
    for part in rows:
        tables.log_append(log, spark.createDataFrame(part, schema))
    reclaimed = []
    stream = stream_of(spark, str(tmp_path), rows, schema)
    for checkpoint, expected in (("one", [0, 1, 2]), ("two", [0, 0, 0])):
        reclaimed.clear()
        writer = usage.sweep(stream, log, lambda n, _: reclaimed.append(n))
        query = writer.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{checkpoint}").start()
        query.awaitTermination(120)
        assert reclaimed == expected
        assert sorted(r["analysis_id"] for r in spark.read.parquet(log).collect()) == ["b", "e"]


def test_commits_are_scanned_once(spark, tmp_path):
    schema = "repo_id long, commit_sha string, scan_version int, config_hash string, language string"
    rows = [[(1, "s1", 6, "h", "fr"), (1, "s1", 6, "h", "fr"), (2, "s1", 6, "h", "fr")], [(1, "s1", 6, "h", "fr"), (1, "s2", 6, "h", "fr")]]
    scanned = []

    def scan(requests):
        scanned.extend((r["repo_id"], r["commit_sha"]) for r in requests.collect())
        return requests.withColumn("payload", F.concat("commit_sha", F.lit("!")))

    cache = f"{tmp_path}/cache"
    stream = stream_of(spark, str(tmp_path), rows, schema)
    for checkpoint in ("one", "two"):  # a replay from the start finds its own entries
        query = incremental.scan_new_commits(stream, cache, scan).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{checkpoint}").start()
        query.awaitTermination(120)
    assert sorted(scanned) == [(1, "s1"), (1, "s2"), (2, "s1")]
    assert spark.read.parquet(cache).count() == 3


def test_admission_as_a_stream(spark, tmp_path):
    """Three batches and a replay from the start decide like the batch operator on all rows."""
    from assayer.operators import runs
    from assayer.streaming import admission

    schema = "user_id long, event_id long, ts timestamp"
    rows = [
        [(1, 10, at(5)), (1, 11, at(1)), (2, 12, at(2)), (1, 13, at(9))],
        [(1, 14, at(20)), (2, 15, at(30)), (3, 16, at(31))],
        [(2, 17, at(40)), (1, 18, at(1500)), (3, 19, at(41)), (3, 20, at(42))],
    ]
    stream = stream_of(spark, str(tmp_path), rows, schema)
    whole = spark.createDataFrame([r for part in rows for r in part], schema)
    expected = {(r.event_id, r.accepted) for r in runs.admit_under_limit(whole, 2).collect()}
    path = f"{tmp_path}/admission"
    for checkpoint in ("one", "two"):
        query = admission.admit_requests(stream, path, 2).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{checkpoint}").start()
        query.awaitTermination(300)
        decided = admission.decisions(spark, path).collect()
        assert {(r.event_id, r.accepted) for r in decided} == expected and len(decided) == 11
    # another stream meets what this one has used
    admission.admit_batch(spark.createDataFrame([(1, 99, at(60)), (4, 98, at(60))], schema), 0, path, 2, source="other")
    other = {r.event_id: r.accepted for r in admission.decisions(spark, path).filter("source = 'other'").collect()}
    assert other == {99: False, 98: True}


def test_a_killed_batch_is_neither_lost_nor_scanned_twice(spark, tmp_path, monkeypatch):
    schema = "repo_id long, commit_sha string, scan_version int, config_hash string, language string"
    asked = spark.createDataFrame([(1, "s1", 6, "h", "fr"), (2, "s1", 6, "h", "fr")], schema)
    cache, ledger = f"{tmp_path}/cache", f"{tmp_path}/ledger"
    scanned = []

    def scan(requests):
        scanned.append(requests.count())
        return requests.withColumn("payload", F.lit("p"))

    def killed(*_):
        raise RuntimeError("killed")

    # between the scan and the put
    monkeypatch.setattr(incremental, "cache_put", killed)
    try:
        incremental.scan_batch_once(asked, 0, cache, ledger, scan)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert scanned == [2]
    incremental.scan_batch_once(asked, 0, cache, ledger, scan)
    incremental.scan_batch_once(asked, 0, cache, ledger, scan)
    assert scanned == [2] and spark.read.parquet(cache).count() == 2

    # while it scans
    def broken(requests):
        raise RuntimeError("killed")

    more = asked.withColumn("commit_sha", F.lit("s2"))
    try:
        incremental.scan_batch_once(more, 1, cache, ledger, broken)
    except RuntimeError:
        pass
    incremental.scan_batch_once(more, 1, cache, ledger, scan)
    assert scanned == [2, 2] and spark.read.parquet(cache).count() == 4
    # a batch of what the cache has scans nothing
    incremental.scan_batch_once(asked.unionAll(more), 2, cache, ledger, scan)
    assert scanned == [2, 2, 0] and spark.read.parquet(cache).count() == 4
