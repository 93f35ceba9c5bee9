"""Tables kept between jobs: bucketed payloads, versions, vectors by content; near copies and cells."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.operators import cells, near, verdicts
from assayer.plans import scan
from assayer.session import new_table_path
from assayer.sources import bucketed, payloads, vectors, versions

TREE = "repo string, commit_sha string, ord long, path string, type string, sha string, size long, truncated boolean"
RAW = "repo string, commit_sha string, path string, http_status int, encoding string, size long, content_b64 string"


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# --- payloads -----------------------------------------------------------------------------


def test_listing_goes_to_stored_payloads(spark):
    path = new_table_path(spark, "payloads")
    table = payloads.open_payloads(spark, path, buckets=8)
    rows = [("r", "c", f"f{i}.py", 200, "base64", 3, "eCA9IDEK") for i in range(40)]
    raw = spark.createDataFrame(rows, RAW)
    payloads.store_payloads(table, raw.filter("path < 'f3'"))
    payloads.store_payloads(table, raw.withColumn("http_status", F.lit(500)))
    again = payloads.open_payloads(spark, path, buckets=99)
    assert again.buckets == 8 and again.keys == ("repo", "commit_sha", "path")
    assert {tuple(r) for r in again.frame(spark).groupBy("http_status").count().collect()} == {(200, 23), (500, 17)}
    tree = spark.createDataFrame([("r", "c", i, f"f{i}.py", "blob", "s", 3, False) for i in range(50)], TREE)
    ready = scan.prepare_files(tree, again, max_files=None)
    plan = formatted(ready.files)
    assert "Bucketed: true" in plan
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert moved and not any("content_b64" in columns for columns in moved)
    assert ready.files.count() == 23
    result = scan.scan_repositories(tree, again, None)
    assert result.coverage.first()["fetched_files"] == 23 and result.metrics.first()["quality"]["ecosystems"] == ["python"]
    bucketed.forget(spark, again)


def test_scan_documents_carry_metrics_and_messages(spark, make_files):
    import json

    from assayer.messages import catalog

    files = make_files([("a.py", "def f(x):\n    return 1 if x else 2\n"), ("t/test_a.py", "x = 1\n"), (".gitignore", "*.log\n")])
    tracked = make_files([("a.py", ""), ("t/test_a.py", ""), (".gitignore", ""), (".github/workflows/x.yml", ""), ("b.log", "")])
    reports = spark.createDataFrame(
        [("r", "c", 0, "ruff", json.dumps([{"code": c, "filename": "a.py", "location": {"row": 1}, "message": "m"} for c in ("F401", "C901")]))],
        "repo string, commit_sha string, report_ord long, tool string, report string",
    )
    done = scan.run_scan(files, tracked.select("repo", "commit_sha", "ord", "path"), linter_reports=reports, catalog=catalog(spark), lang="en")
    stored = json.loads(scan.scan_payloads(done, "en").first()["payload"])
    assert [a["axis"] for a in stored["axes"]] == ["secrets_detection", "gitignore_check", "quality_check", "readme_check"]
    by_axis = {a["axis"]: a for a in stored["axes"]}
    assert by_axis["secrets_detection"]["metrics"] == {} and by_axis["readme_check"]["metrics"] == {}
    assert by_axis["readme_check"]["status"] == "unavailable" and by_axis["readme_check"]["message"].startswith("README vs Code analysis")
    assert by_axis["gitignore_check"]["metrics"] == {"gitignore_files": 1, "rules": 1, "tracked_but_ignored": 1, "unprotected": 0}
    counted = by_axis["quality_check"]["metrics"]
    assert counted["linter_issues"] == 1 and counted["ci_files"] == [".github/workflows/x.yml"]
    assert (counted["source_files_in_sample"], counted["test_files_in_sample"], counted["test_ratio_in_sample"]) == (2, 1, 1.0)
    assert counted["complexity"]["analyzed_functions"] == 1 and counted["complexity"]["max"] == 2
    assert len(by_axis["quality_check"]["findings"]) + by_axis["quality_check"]["dropped"] >= 1


def test_no_limit_keeps_every_finding(make_files):
    from assayer.operators import findings

    files = make_files([(f"k{i}/.env", "A=1\n") for i in range(40)])
    merged = findings.merge_findings(scan.secrets_axis(files))
    assert findings.rank_findings(merged).count() == 30 and findings.rank_findings(merged, None).count() == 40
    assert findings.axis_counts(merged, None).first()["dropped"] == 0


# --- versions -----------------------------------------------------------------------------


def test_two_writers_leave_one_entry(spark):
    path = new_table_path(spark, "versions")
    table = versions.open_versions(spark, path, "k long, part string, v string", ["k", "part"], buckets=8)
    rows = spark.createDataFrame([(i, "x", "one") for i in range(20)], "k long, part string, v string")
    versions.put(table, rows)
    files = {r.file: r.n for r in spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()}
    versions.put(table, rows.withColumn("v", F.lit("two")))
    opened = versions.open_versions(spark, path, "other long", ["other"], buckets=3)
    assert opened == table
    first = versions.current(spark, opened, first=True).collect()
    assert len(first) == 20 and {r.v for r in first} == {"one"}
    assert {r.v for r in versions.current(spark, opened).collect()} == {"two"}
    now = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    assert set(files) <= now, "nothing is rewritten"
    asked = spark.createDataFrame([(3,), (99,)], "k long")
    found = versions.current(spark, opened, asked)
    assert [(r.k, r.v) for r in found.collect()] == [(3, "two")]
    assert re.search(r"PartitionFilters: \[.*bucket", formatted(found))
    versions.remove(opened, asked)
    assert versions.current(spark, opened).count() == 19 and versions.current(spark, opened, asked).count() == 0
    versions.put(opened, rows.filter("k = 3").withColumn("v", F.lit("back")))
    assert versions.current(spark, opened, asked, first=True).first().v == "back"


def test_groups_are_replaced_whole(spark):
    table = versions.open_versions(spark, new_table_path(spark, "groups"), "run long, aspect string", ["run", "aspect"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "run long, aspect string")
    versions.put_group(table, rows((1, "a"), (1, "b"), (2, "a")), rows((1, ""), (2, "")))
    versions.put_group(table, rows((1, "c")), rows((1, ""), (3, "")))
    versions.put_group(table, rows((1, "c")).limit(0), rows((2, "")))
    assert {tuple(r) for r in versions.newest_group(spark, table).collect()} == {(1, "c")}


# --- vectors by content -------------------------------------------------------------------


def test_a_second_commit_encodes_what_changed(spark):
    seen = []

    def encoder(df):
        seen.append(sorted(r.content for r in df.select("content").collect()))
        return df.withColumn("embedding", F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")))

    store = vectors.open_store(spark, new_table_path(spark, "store"), buckets=4)
    schema = "collection string, id string, path string, chunk_index int, content string"
    chunk = lambda c, i, text: (c, f"{c}-{i}", f"p{i}", 0, text)
    one = spark.createDataFrame([chunk("c1", 1, "alpha"), chunk("c1", 2, "beta"), chunk("c1", 3, "alpha")], schema)
    two = spark.createDataFrame([chunk("c2", 1, "alpha"), chunk("c2", 2, "gamma"), chunk("c1", 9, "late")], schema)
    vectors.add_collections(store, one, encoder)
    vectors.add_collections(store, two, encoder)
    vectors.add_collections(store, two, encoder)
    assert seen == [["alpha", "beta"], ["gamma"], []]
    found = vectors.read_collections(store, spark.createDataFrame([("c2",)], "collection string")).collect()
    assert {(r.id, r.content, tuple(r.embedding)) for r in found} == {("c2-1", "alpha", (5.0, 1.0)), ("c2-2", "gamma", (5.0, 1.0))}
    again = vectors.open_store(spark, store.texts.path.rsplit("/", 1)[0])
    assert again.texts.frame(spark).count() == 3 and again.references.frame(spark).count() == 5


# --- near copies --------------------------------------------------------------------------


def brute_groups(blocks, percent, size):
    sets = {}
    for path, text in blocks:
        words = text.split()
        if words:
            sets[path] = {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))}
    linked = set()
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                linked.add((a, b))
    return linked


def test_near_copies_against_brute_force(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    blocks = []
    for family in range(25):
        base = [draw.choice(words) for _ in range(draw.randint(3, 120))]
        for copy in range(draw.randint(1, 6)):
            text = [w if draw.random() > 0.01 * copy else "x" for w in base]
            blocks.append((f"{family}/{copy}", "  ".join(text)))
    blocks += [("blank", " \n"), ("none", None), ("hot/0", "one two")] + [(f"hot/{i}", "One two three four five six") for i in range(1, 60)]
    frame = spark.createDataFrame([("r", p, 0, t) for p, t in blocks], "repo string, path string, chunk_index int, content string")
    found = near.near_duplicates(frame, ["repo"])
    group = {r.path: r.first_path for r in found.members.collect()}
    linked = brute_groups([(p, t or "") for p, t in blocks], 80, 5)
    together = sum(a in group and group[a] == group.get(b) for a, b in linked)
    assert together >= 0.9 * len(linked)
    # whatever is told to be linked is
    sets = {r.block: r.representative for r in found.links.collect()}
    assert all(r.similarity >= 0.8 for r in found.links.collect()) and sets
    assert "blank" not in group and "none" not in group and "hot/0" not in group
    # copies are one node: sixty files cost one row
    assert found.links.count() < len(blocks)
    other = near.near_duplicates(frame.withColumn("repo", F.col("path")), ["repo"])
    assert other.members.count() == 0, "scopes do not mix"
    assert near.near_duplicates(frame.limit(0), ["repo"]).members.count() == 0


# --- pruned top-k -------------------------------------------------------------------------


def test_pruned_top_k_is_exact(spark):
    draw = random.Random(9)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(1500):
        centre = centres[i % 12]
        rows.append((i, "big" if i % 50 else "small", [c + draw.gauss(0, 0.1) for c in centre]))
    rows += [(5000, "big", [0.0] * 8), (5001, "one", [1.0] * 8), (5002, "big", rows[3][2]), (5003, "big", rows[3][2])]
    frame = spark.createDataFrame(rows, "id long, collection string, embedding array<double>")
    asked = [("a", "big", rows[3][2]), ("b", "big", [0.0] * 8), ("c", "small", centres[2]), ("d", "one", [-1.0] * 8), ("e", "none", [1.0] * 8), ("f", "big", centres[5])]
    queries = spark.createDataFrame(asked, "query_id string, collection string, embedding array<double>")

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(dot / size, 4) if size else 0.0

    found = cells.top_k(queries, cells.build_cells(frame), 7, "bigint")
    got = sorted((r.query_id, r["rank"], r.id, r.similarity) for r in found.hits.collect())
    expected = []
    for query, collection, vector in asked:
        scored = sorted((-cosine(vector, e), i) for i, c, e in rows if c == collection)[:7]
        expected += [(query, at + 1, str(i), -s) for at, (s, i) in enumerate(scored)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(expected)]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(expected)], abs=1e-9)
    met = {r.query_id: (r.met, r.cells) for r in found.skipped.collect()}
    assert met["f"][0] < met["f"][1] / 2, "most cells are skipped"


# --- verdicts by call ---------------------------------------------------------------------


def test_one_bad_call_spoils_only_itself(spark):
    import json

    scope = ("r", "c", "secrets_detection")
    issues = spark.createDataFrame([(*scope, i, f"f{i}") for i in range(40)], "repo string, commit_sha string, axis string, place int, id string")
    sent = verdicts.submitted(issues)
    assert {(r.call, r["count"]) for r in sent.groupBy("call").count().collect()} == {(0, 30), (1, 10)}

    def answers(*parts):
        rows = [(*scope, call, json.dumps({"verdicts": [{"finding_id": f"f{i}", "verdict": "confirmed"} for i in ids]})) for call, ids in parts]
        return spark.createDataFrame(rows, "repo string, commit_sha string, axis string, call int, raw string")

    good = answers((0, range(30)), (1, range(30, 40)))
    assert verdicts.validate_verdicts(good, sent).count() == 40
    mixed = answers((0, range(30)), (1, [30, 5]))  # the second names an id of the first
    assert verdicts.validate_verdicts(mixed, sent).count() == 30
    assert {(r.call, r.status) for r in verdicts.answer_statuses(mixed, sent).collect()} == {(0, "accepted"), (1, "error")}
