"""Report exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import rules
from assayer.messages import catalog
from assayer.plans.scan import scan_payloads
from assayer.sources import exports
from checks.axes import DOC_METRICS, IGNORE_METRICS, SCAN_CTE, SCAN_LIMIT, _owner, _scan
from checks.corpus import SUFFIX, sql_list
from checks.paths import CI_PATH, TEST_PATH
from checks.registry import query, table


def report_runs(spark, sf_dir):
    n = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        n.alias("id"),
        F.concat(F.lit("owner/repo"), F.col("user_id").cast("string")).alias("repo_name"),
        F.md5(n.cast("string")).alias("repo_sha"),
        F.col("event_type").alias("status"),
        F.when(n % 2 == 0, F.lit("en_GB")).otherwise(F.lit("de")).alias("language"),
        F.date_trunc("second", ts).alias("created_at"),
        F.when(n % 3 == 0, ts).alias("completed_at"),
    )


def report_results(spark, sf_dir):
    n = F.col("event_id")
    aspects = F.array(F.lit("quality_check"), F.lit("readme_check"), F.lit("own_check"))
    states = F.array(F.lit("clean"), F.lit("partial"), F.lit("odd"))
    return table(spark, sf_dir, "events").select(
        n.alias("analysis_id"),
        F.posexplode(aspects).alias("pos", "aspect"),
    ).select(
        "analysis_id", "aspect", F.element_at(states, ((F.col("analysis_id") + F.col("pos")) % 3).cast("int") + 1).alias("status")
    )


RESULTS = """results AS (SELECT event_id AS id, aspect, ['clean', 'partial', 'odd'][CAST((event_id + pos) % 3 AS INT) + 1] AS status, event_id % 2 = 0 AS english FROM (
    SELECT event_id, unnest(['quality_check', 'readme_check', 'own_check']) AS aspect, unnest([0, 1, 2]) AS pos FROM events)),
  labelled AS (SELECT *, CASE aspect WHEN 'quality_check' THEN CASE WHEN english THEN 'Code quality' ELSE 'Qualite du code' END WHEN 'readme_check' THEN 'README vs Code' ELSE aspect END AS aspect_label,
    CASE status WHEN 'clean' THEN CASE WHEN english THEN 'No issue' ELSE 'Aucun probleme' END
      WHEN 'partial' THEN CASE WHEN english THEN 'No issue in the analyzed subset' ELSE 'Aucun probleme sur la partie analysee' END ELSE status END AS status_label FROM results)"""


@query(f"WITH {RESULTS} SELECT id, aspect, status, aspect_label, status_label FROM labelled")
def labelled_results(spark, sf_dir):
    shown = exports.labelled_results(report_runs(spark, sf_dir), report_results(spark, sf_dir), catalog(spark))
    return shown.select(F.col("analysis_id").alias("id"), "aspect", "status", "aspect_label", "status_label")


_ENTRY = """concat('{"aspect":"', aspect, '","aspect_label":"', aspect_label, '","status":"', status, '","status_label":"', status_label, '"}')"""


@query(
    f"""WITH {RESULTS}, listed AS (SELECT id, string_agg({_ENTRY}, ',' ORDER BY aspect) AS entries FROM labelled GROUP BY id)
    SELECT event_id AS id, concat('{{"repo_name":"owner/repo', user_id, '","repo_sha":"', md5(CAST(event_id AS VARCHAR)), '","status":"', event_type, '","language":"', CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'fr' END,
      '","created_at":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '"', CASE WHEN event_id % 3 = 0 THEN concat(',"completed_at":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '"') ELSE '' END, ',"results":[', entries, ']}}') AS report
    FROM events JOIN listed ON listed.id = event_id"""
)
def exported_reports(spark, sf_dir):
    return exports.export_reports(report_runs(spark, sf_dir), report_results(spark, sf_dir), catalog(spark))


PAYLOAD = """struct<scan_version: string, language: string, complete: boolean, coverage: struct<tracked_files: bigint, fetched_files: bigint, skipped: bigint>,
  axes: array<struct<axis: string, status: string, dropped: bigint, message: string, findings: array<struct<id: string, rank: int, title: string>>,
    metrics: struct<gitignore_files: bigint, rules: bigint, tracked_but_ignored: bigint, unprotected: bigint, documents: bigint, env_used: bigint, env_declared: bigint,
      has_env_example: boolean, ecosystems: array<string>, source_files_in_sample: bigint, test_files_in_sample: bigint, test_ratio_in_sample: double, has_sources: boolean,
      has_tests: boolean, ci_files: array<string>, has_ci: boolean, missing_lockfiles: array<string>, pinned_requirements: boolean, linter_issues: bigint,
      complexity: struct<threshold: int, analyzed_functions: bigint, over_threshold: bigint, max: int, average: double, analyzed_languages: array<string>, unanalyzed_languages: array<string>>>>>,
  summary: struct<findings: bigint, dropped: bigint, critical: bigint, axes_with_issues: array<string>>>"""
SUMMED = f"""levels AS (SELECT repo, commit_sha, count(*) FILTER (WHERE severity = 'critical') AS critical FROM ranked WHERE rank <= {SCAN_LIMIT} GROUP BY ALL),
  summed AS (SELECT s.repo, s.commit_sha, CAST(sum(s.kept) AS BIGINT) AS total, CAST(sum(s.dropped) AS BIGINT) AS total_dropped, coalesce(any_value(l.critical), 0) AS critical
    FROM statuses s LEFT JOIN levels l ON (l.repo, l.commit_sha) = (s.repo, s.commit_sha) GROUP BY ALL)"""


@query(
    f"""WITH {SCAN_CTE}, {SUMMED} SELECT s.repo, s.commit_sha, CAST(s.axes AS INTEGER) AS axes, s.complete, c.tracked_files, c.fetched_files, c.skipped, t.total, t.total_dropped, t.critical, s.with_issues
    FROM (SELECT repo, commit_sha, count(*) AS axes, bool_and(complete) AS complete, coalesce(string_agg(axis, ',' ORDER BY list_position({rules.AXES}, axis)) FILTER (WHERE status = 'issues_found'), '') AS with_issues FROM statuses GROUP BY ALL) s
    LEFT JOIN coverage c ON (c.repo, c.commit_sha) = (s.repo, s.commit_sha) JOIN summed t ON (t.repo, t.commit_sha) = (s.repo, s.commit_sha)"""
)
def cached_payloads(spark, sf_dir):
    """The stored document of every scan: its coverage and summary."""
    payloads = scan_payloads(_scan(spark, sf_dir, with_catalog=True), "en")
    parsed = payloads.withColumn("p", F.from_json("payload", PAYLOAD))
    return parsed.select(
        "repo", "commit_sha", F.size("p.axes").alias("axes"), "p.complete", "p.coverage.tracked_files", "p.coverage.fetched_files", "p.coverage.skipped",
        F.col("p.summary.findings").alias("total"), F.col("p.summary.dropped").alias("total_dropped"), "p.summary.critical",
        F.array_join("p.summary.axes_with_issues", ",").alias("with_issues"),
    )


_LISTED = "coalesce((SELECT string_agg(id, ' ' ORDER BY rank) FROM ranked r WHERE (r.repo, r.commit_sha, r.axis) = (s.repo, s.commit_sha, s.axis) AND rank <= {limit}), '')"
_OF = "(x.repo, x.commit_sha) = (s.repo, s.commit_sha)"
QUALITY_METRICS = f"""sampled AS (SELECT repo, commit_sha, count(*) FILTER (WHERE src) AS sources, count(*) FILTER (WHERE src AND test) AS tests
    FROM (SELECT repo, commit_sha, {SUFFIX} IN {sql_list(rules.ALL_SOURCE_EXTENSIONS)} AS src, {TEST_PATH} AS test FROM files) GROUP BY ALL),
  analyzed AS (SELECT repo, commit_sha, bool_or({SUFFIX} = '.py') AS python FROM files GROUP BY ALL),
  functions AS (SELECT repo, commit_sha, count(*) AS n, count(*) FILTER (WHERE score > 10) AS over, max(score) AS top, round_even(avg(score), 1) AS mean FROM scores GROUP BY ALL),
  linted AS (SELECT repo, commit_sha, count(*) AS n FROM numbered GROUP BY ALL),
  foreign_ AS (SELECT DISTINCT repo, commit_sha, {_owner(SUFFIX, rules.SOURCE_EXTENSIONS)} AS eco FROM files),
  quality_metrics AS (SELECT s.repo, s.commit_sha, (SELECT string_agg(ecosystem, ',' ORDER BY ecosystem) FROM detected x WHERE {_OF}) AS ecosystems,
      (SELECT string_agg(ecosystem, ',' ORDER BY ecosystem) FROM unlocked x WHERE {_OF}) AS missing_lockfiles, f.has_sources, f.has_tests, f.has_ci,
      (SELECT string_agg(path, ',' ORDER BY ord) FROM paths x WHERE {_OF} AND {CI_PATH}) AS ci_files,
      EXISTS (SELECT 1 FROM pinned_repos x WHERE {_OF}) AS pinned_requirements, coalesce((SELECT n FROM linted x WHERE {_OF}), 0) AS linter_issues,
      m.sources AS source_files_in_sample, m.tests AS test_files_in_sample, CASE WHEN m.sources > m.tests THEN round_even(m.tests / (m.sources - m.tests), 2) END AS test_ratio,
      coalesce(c.n, 0) AS analyzed_functions, c.top AS max_complexity, c.mean AS mean_complexity, CASE WHEN a.python THEN coalesce(c.over, 0) END AS over_threshold,
      (SELECT string_agg(eco, ',' ORDER BY eco) FROM foreign_ x WHERE {_OF} AND eco <> 'python') AS unanalyzed
    FROM scopes s JOIN flags f ON (f.repo, f.commit_sha) = (s.repo, s.commit_sha) LEFT JOIN sampled m ON (m.repo, m.commit_sha) = (s.repo, s.commit_sha)
    LEFT JOIN analyzed a ON (a.repo, a.commit_sha) = (s.repo, s.commit_sha) LEFT JOIN functions c ON (c.repo, c.commit_sha) = (s.repo, s.commit_sha))"""
_IGNORE_FIELDS = ["gitignore_files", "rules", "tracked_but_ignored", "unprotected"]
_DOC_FIELDS = ["documents", "env_used", "env_declared", "has_env_example"]
_TEXT_FIELDS = ["ecosystems", "missing_lockfiles", "ci_files", "unanalyzed"]
_PLAIN_FIELDS = [
    "has_sources", "has_tests", "has_ci", "pinned_requirements", "linter_issues", "source_files_in_sample",
    "test_files_in_sample", "test_ratio", "analyzed_functions", "max_complexity", "mean_complexity", "over_threshold",
]


def _shown(fields, alias, condition, empty=False):
    value = "coalesce({a}.{f}, '')" if empty else "{a}.{f}"
    return ", ".join(f"CASE WHEN {condition} THEN {value.format(a=alias, f=f)} END AS {f}" for f in fields)


@query(
    f"""WITH {SCAN_CTE}, {IGNORE_METRICS}, {DOC_METRICS}, {QUALITY_METRICS} SELECT s.repo, s.commit_sha, s.axis, s.status, s.dropped, {_LISTED.format(limit=SCAN_LIMIT)} AS ids,
      CASE WHEN s.status = 'unavailable' THEN 'README vs Code analysis unavailable — no README.md found in this repository.' END AS message,
      {_shown(_IGNORE_FIELDS, 'i', "s.axis = 'gitignore_check'")}, {_shown(_DOC_FIELDS, 'd', "s.axis = 'readme_check' AND s.status <> 'unavailable'")},
      {_shown(_TEXT_FIELDS, 'q', "s.axis = 'quality_check'", True)}, {_shown(_PLAIN_FIELDS, 'q', "s.axis = 'quality_check'")}
    FROM statuses s JOIN ignore_metrics i ON (i.repo, i.commit_sha) = (s.repo, s.commit_sha) JOIN doc_metrics d ON (d.repo, d.commit_sha) = (s.repo, s.commit_sha)
    JOIN quality_metrics q ON (q.repo, q.commit_sha) = (s.repo, s.commit_sha)"""
)
def payload_axes(spark, sf_dir):
    """Every axis of the stored documents: status, message, findings in order, metrics."""
    payloads = scan_payloads(_scan(spark, sf_dir, with_catalog=True), "en")
    axes = payloads.select("repo", "commit_sha", F.explode(F.from_json("payload", PAYLOAD)["axes"]).alias("a"))
    metric = lambda name: F.col("a.metrics")[name]
    complexity = lambda name: metric("complexity")[name]
    own = {"test_ratio": metric("test_ratio_in_sample"), "max_complexity": complexity("max"), "mean_complexity": complexity("average")}
    own |= {name: complexity(name) for name in ("analyzed_functions", "over_threshold")}
    listed = {"unanalyzed": complexity("unanalyzed_languages")}
    return axes.select(
        "repo", "commit_sha", "a.axis", "a.status", "a.dropped", F.array_join("a.findings.id", " ").alias("ids"), "a.message",
        *[metric(name).alias(name) for name in _IGNORE_FIELDS + _DOC_FIELDS],
        *[F.array_join(listed[name] if name in listed else metric(name), ",").alias(name) for name in _TEXT_FIELDS],
        *[(own[name] if name in own else metric(name)).alias(name) for name in _PLAIN_FIELDS],
    )
