"""The four axes on small repositories."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer import messages, rules
from assayer.operators import KEY, findings
from assayer.operators.localize import localize_findings
from assayer.plans import scan

FILES = [
    (".gitignore", "build/\n"),
    ("ops/.env", "BILLING_TOKEN=ghp_h7Qm2Zt9LxV4cR8sKd3WnB6yPf1JgT5uEa0M\n"),
    ("README.md", "Start with [the setup](notes/setup.md).\n"),
    ("worker.py", "import os\n\n\nQUEUE = os.environ['QUEUE_URL']\n"),
    ("requirements.txt", "celery\nredis\nboto3\n"),
]
CLEAN = [
    (".gitignore", "__pycache__/\n.venv/\nbuild/\n.env\n"),
    ("README.md", "# Worker\n\nRuns the nightly jobs.\n"),
    ("worker.py", "def double(n):\n    return 2 * n\n"),
    ("tests/test_worker.py", "from worker import double\n\n\ndef test_double():\n    assert double(2) == 4\n"),
    (".github/workflows/nightly.yml", "on: push\n"),
    ("requirements.txt", "celery==5.4.0\nredis==5.0.8\nboto3==1.35.2\n"),
    ("uv.lock", "version = 1\n"),
]
ADDED = ("jobs/report.py", "SOURCE = 'postgresql://report:tulip99@warehouse.example.org/sales'\n")


def tracked_of(files):
    return files.select(*KEY, "ord", "path")


def rows_of(found):
    kept = findings.rank_findings(findings.merge_findings(found), 100)
    return sorted(kept.collect(), key=lambda r: (r["axis"], r["rank"]))


def rules_of(found):
    return {r["rule"] for r in rows_of(found)}


def status_map(result):
    return {r["axis"]: r["status"] for r in result.statuses.collect()}


def test_issues_on_every_axis(make_files):
    files = make_files(FILES)
    result = scan.run_scan(files, tracked_of(files))
    assert status_map(result) == dict.fromkeys(rules.AXES, "issues_found")
    summary = result.summary.first()
    assert summary["axes_with_issues"] == rules.AXES
    assert summary["critical"] > 0
    found = result.findings.collect()
    assert len({r["id"] for r in found}) == len(found) == summary["findings"]


def test_clean_and_partial(spark, make_files):
    schema = "repo string, commit_sha string, tree_truncated boolean, capped_over_limit long, fetch_failures map<string,long>"
    gaps = {
        "none": (False, 0, {}),
        "truncated": (True, 0, {}),
        "capped": (False, 1200, {}),
        "failures": (False, 0, {"fetch_http_error": 3}),
    }
    files = make_files(CLEAN, repo="unknown")
    for name in gaps:
        files = files.unionByName(make_files(CLEAN, repo=name))
    coverage = spark.createDataFrame([(name, "c", *gap) for name, gap in gaps.items()], schema)
    result = scan.run_scan(files, tracked_of(files), coverage)
    statuses = {}
    for row in result.statuses.collect():
        statuses.setdefault(row["repo"], set()).add(row["status"])
    partial = {name: {"partial"} for name in ("truncated", "capped", "failures")}
    assert statuses == {"none": {"clean"}, "unknown": {"clean"}, **partial}


def test_delta_between_commits(make_files):
    before = scan.secrets_axis(make_files(FILES))
    after = scan.secrets_axis(make_files([*FILES, ADDED]))
    delta = findings.finding_delta(before, after, [*KEY, "id"]).collect()
    assert {r["change"] for r in delta} == {"added", "unchanged"}
    assert all(("jobs/report.py" in r["id"]) == (r["change"] == "added") for r in delta)


def test_titles_follow_the_language(spark, make_files):
    files = make_files(FILES)
    catalog = messages.catalog(spark)
    tracked = tracked_of(files)
    found = findings.union_findings(
        scan.secrets_axis(files), scan.docs_axis(files, tracked), scan.quality_axis(files, tracked)
    )
    kept = findings.rank_findings(findings.merge_findings(found))
    shown = {}
    for lang in ("fr", "en"):
        rows = localize_findings(kept, catalog, F.lit(lang)).collect()
        shown[lang] = {r["rule"]: (r["title"], r["description"]) for r in rows}
    assert shown["fr"]["committed.env"][0] == "Fichier .env commite dans le depot"
    assert shown["en"]["committed.env"][0] == ".env file committed to the repository"
    assert shown["en"]["docs.undocumented_env"][1].startswith("The code reads QUEUE_URL (first use at line 4)")
    assert shown["en"]["docs.broken_link"][1].startswith("Line 1: the link points to notes/setup.md,")
    assert shown["en"]["quality.unpinned_dependencies"][1].startswith("Only 0 out of 3")
    assert all("{" not in text for texts in shown.values() for pair in texts.values() for text in pair)


# --- secrets ------------------------------------------------------------------------------


def test_secret_lines(make_files):
    aws, github = "AKIA" + "IOSFODNN7EXAMPL1", "ghp_" + "a" * 36
    files = make_files(
        [
            ("config.py", f"x\nkey = '{aws}'  \n"),
            ("app.js", f"const t = '{github}'"),
            (".env.example", f"KEY={aws}"),
            ("a.py", f"# placeholder {aws}\n# FAKE {github}"),
            ("tests/b.py", f"{github} {aws}"),
        ]
    )
    found = {r["file_path"]: r for r in rows_of(scan.secrets_axis(files))}
    assert set(found) == {"config.py", "app.js", "tests/b.py"}
    assert (found["config.py"]["rule"], found["config.py"]["line"], found["config.py"]["evidence"]) == (
        "secret.aws_key", 2, f"key = '{aws}'",
    )
    assert found["tests/b.py"]["rule"] == "secret.aws_key", "the first rule of the table wins"
    assert found["tests/b.py"]["context"] == "test" and found["app.js"]["context"] is None


def test_rules_with_anchors_are_matched_line_by_line(make_files):
    files = make_files([("a.txt", "one\nTOKEN here\nlast")])
    found = rows_of(scan.secrets_axis(files, secret_rules=[("own", "^TOKEN here$", "low")]))
    assert [(r["line"], r["severity"]) for r in found] == [(2, "low")]


# --- documentation ------------------------------------------------------------------------


def docs(make_files, entries, extra=()):
    files = make_files(entries)
    tracked = tracked_of(make_files([*entries, *[(p, "") for p in extra]]))
    return rows_of(scan.docs_axis(files, tracked))


def test_broken_links(make_files):
    readme = ("README.md", "See [g](docs/guide.md) and [g2](./docs/guide.md)\n")
    broken = docs(make_files, [readme])
    assert [(r["rule"], r["line"], r["evidence"], r["occurrences"]) for r in broken] == [
        ("docs.broken_link", 1, "docs/guide.md", 2)
    ]
    assert docs(make_files, [readme], extra=["docs/guide.md"]) == []
    skipped = "[a](https://x.y/z.md) [b](mailto:a@b.c) [c](#top) ![d](x.png) [e](tool.exe) [f](docs/) [g](../up.md)"
    assert docs(make_files, [("README.md", skipped)]) == []


def test_environment_variables(make_files):
    code = ("app.py", "import os\n\nX = os.getenv('APP_SECRET')\nP = os.environ['PORT']\n")
    found = docs(make_files, [("README.md", "nothing"), code])
    assert [(r["rule"], r["evidence"], r["line"]) for r in found] == [("docs.undocumented_env", "APP_SECRET", 3)]
    assert docs(make_files, [("README.md", "set APP_SECRET"), code]) == []
    assert docs(make_files, [("README.md", "x"), (".env.example", "export APP_SECRET=1"), code]) == []
    assert docs(make_files, [("README.md", "x"), ("tests/t.py", "os.getenv('ONLY_TEST')")]) == []
    unused = docs(make_files, [("README.md", "x"), (".env.example", "# A_B=1\nOLD_FLAG=1\nlower=2")])
    assert [(r["rule"], r["severity"], r["evidence"]) for r in unused] == [("docs.unused_env", "low", "OLD_FLAG")]


def test_word_boundaries_in_documents(make_files):
    code = ("a.js", "process.env.ABC; process.env['DEF']; import.meta.env.GHI")
    found = docs(make_files, [("README.md", "éABC ABCé x_DEF, `GHI`"), code])
    assert sorted(r["evidence"] for r in found if r["rule"] == "docs.undocumented_env") == ["ABC", "DEF"]


def test_missing_template_and_missing_documents(make_files):
    reads = ("a.js", "process.env.AAA + process.env.BBB + process.env.CCC")
    found = docs(make_files, [("README.md", "AAA BBB CCC"), reads])
    assert [r["rule"] for r in found] == ["docs.no_env_example"]
    assert docs(make_files, [("README.md", "AAA BBB CCC"), reads], extra=["x/.env.dist"]) == []
    assert docs(make_files, [reads]) == [], "no document, no documentation axis"


# --- quality ------------------------------------------------------------------------------

COMPLEX = """
def handler(value):
    if value == 1:
        return 1
    elif value == 2:
        return 2
    elif value == 3:
        return 3
    for item in range(10):
        if item:
            pass
    while value:
        value -= 1
    try:
        pass
    except ValueError:
        pass
    except KeyError:
        pass
    return [x for x in range(3) if x]
"""


@pytest.mark.parametrize(
    "source, scores",
    [
        ("def f(a, b):\n    if a and b:\n        return 1\n    return 0\n", [3]),
        ("def outer():\n    def inner():\n        if 1:\n            pass\n    return inner\n", [1, 2]),
        ("def add(a, b):\n    return a + b\n", [1]),
        (COMPLEX, [11]),
        ("def broken(:\n", []),
        ("async def f(x):\n    match x:\n        case 1: pass\n        case _: pass\n    return 1 if x else 2\n", [4]),
        ("def f(x):\n    return " + "(" * 300 + "x" + ")" * 300, []),
    ],
)
def test_complexity(make_files, source, scores):
    from assayer.operators.quality import function_complexity

    found = function_complexity(make_files([("a.py", source), ("b.js", source)])).orderBy("item").collect()
    assert [r["score"] for r in found] == scores


def test_complex_function_finding(make_files):
    files = make_files([("src/handler.py", COMPLEX), ("tests/a.py", "")])
    found = [r for r in rows_of(scan.quality_axis(files, tracked_of(files))) if r["source"] == "ast"]
    assert [(r["rule"], r["line"], r["severity"]) for r in found] == [("quality.complex_function", 2, "medium")]
    shifted = make_files([("src/handler.py", "x = 1\n" + COMPLEX)])
    again = [r for r in rows_of(scan.quality_axis(shifted, tracked_of(shifted))) if r["source"] == "ast"]
    assert again[0]["id"] == found[0]["id"] and again[0]["line"] == 3


def test_absence_rules_look_at_tracked_paths(make_files):
    sample = make_files([("src/index.js", "export const x = 1;\n")])
    tracked = ["src/index.js", "package.json", "yarn.lock", "src/index.test.js", ".github/workflows/ci.yml"]
    wide = tracked_of(make_files([(p, "") for p in tracked]))
    assert rules_of(scan.quality_axis(sample, wide)) == set()
    assert rules_of(scan.quality_axis(sample, tracked_of(sample))) == {
        "quality.no_tests", "quality.no_ci", "quality.no_lockfile",
    }


def test_lockfile_severity_depends_on_pinning(make_files):
    for body, rule, severity in [
        ("fastapi==1.0\nrequests==2.0\nhttpx==0.28\n", "quality.pinned_without_lockfile", "info"),
        ("fastapi\nrequests\nhttpx\n", "quality.no_lockfile", "medium"),
    ]:
        files = make_files([("requirements.txt", body), ("app.py", "x = 1")])
        found = {r["rule"]: r["severity"] for r in rows_of(scan.quality_axis(files, tracked_of(files)))}
        assert found[rule] == severity
        assert ("quality.unpinned_dependencies" in found) == (severity == "medium")


def test_java_has_no_lockfile_to_miss(make_files):
    files = make_files([("pom.xml", ""), ("A.java", "")])
    assert "quality.no_lockfile" not in rules_of(scan.quality_axis(files, tracked_of(files)))


# --- finding algebra ----------------------------------------------------------------------


def raw_findings(spark, rows):
    df = spark.createDataFrame(
        [("r", "c", i, *row) for i, row in enumerate(rows)],
        "repo string, commit_sha string, i long, severity string, path string, line int, evidence string",
    )
    return findings.make_findings(
        df, axis="axis", rule=F.lit("rule"), severity=F.col("severity"), file_path=F.col("path"),
        line=F.col("line"), evidence=F.col("evidence"), file_ord=F.col("i"),
    )


def test_merge_keeps_locations_in_first_seen_order(spark):
    merged = findings.merge_findings(
        raw_findings(spark, [("low", "a.py", 87, "KEY=x"), ("low", "a.py", 12, "KEY=x"), ("low", "a.py", 87, "KEY=x")])
    ).collect()
    assert len(merged) == 1
    assert (merged[0]["occurrences"], merged[0]["line"]) == (2, 87)
    assert [p["line"] for p in merged[0]["locations"]] == [87, 12]


def test_cap_and_rank(spark):
    scopes = spark.createDataFrame([("r", "c")], "repo string, commit_sha string")
    many = raw_findings(spark, [("low", f"f{i}.py", None, "") for i in range(5)])
    result = findings.axis_results(scopes, many, limit=2, axes=["axis"]).first()
    assert (len(result["findings"]), result["dropped"], result["status"]) == (2, 3, "issues_found")
    mixed = raw_findings(spark, [("low", "a", 1, ""), ("critical", "b", 1, ""), ("odd", "c", 1, ""), ("medium", "d", 1, "")])
    result = findings.axis_results(scopes, mixed, axes=["axis", "other"]).collect()
    by_axis = {r["axis"]: r for r in result}
    assert [f["severity"] for f in by_axis["axis"]["findings"]] == ["critical", "medium", "low", "low"]
    assert by_axis["other"]["status"] == "clean" and by_axis["other"]["findings"] == []


def test_identity(spark):
    ids = [r["id"] for r in raw_findings(spark, [("low", "a.py", 4, "x = 1"), ("low", "a.py", 90, "x  = 1"), ("low", "b.py", 4, "x = 1"), ("low", "a.py", 4, "y = 2"), ("low", None, 4, "")]).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 4
    assert ids[4] == "axis:rule:-:-"


def test_stored_shape(spark):
    info = raw_findings(spark, [("info", None, None, "e")])
    issue = findings.legacy_issue(findings.rank_findings(findings.merge_findings(info))).first()
    assert (issue["severity"], issue["file_path"], issue["code_hint"]) == ("low", "N/A", "e")


def test_config_hash_is_stable():
    assert len(scan.config_hash()) == 16 and scan.config_hash() == scan.config_hash()
