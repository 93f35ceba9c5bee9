"""The four axes and the finding algebra, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import rules
from assayer.messages import catalog
from assayer.operators import coverage as C
from assayer.operators import documents, findings, ignore, lines, quality
from assayer.plans import scan
from assayer.session import materialize, new_table_path
from assayer.sources import payloads as P
from checks.corpus import (
    BASE, FILES, IGNORE_RULES, LINES, NAME, PATHS, SUFFIX, files, sql_fingerprint, sql_list, tracked,
)
from checks.coverage import CAP, COVERAGE, GUARDS, KEPT, MAX_SIZE, TREE, payloads, prepared, tree
from checks.linters import LINT_RAW_OF, lint_sql, linter_reports
from checks.paths import ALLOWED, CI_PATH, SENSITIVE, TEST_PATH, sql_map
from checks.registry import query
from checks.texts import (
    DECLARED, ENV_READS, FIRST_USE, LINKS, MARKDOWN, MENTIONED, REQUIREMENTS, RESOLVED, RULES, SECRETS,
)

K = ["repo", "commit_sha"]
RANK = "list_position(['critical', 'high', 'medium', 'low', 'info'], severity)"
COLUMNS = "repo, commit_sha, axis, rule, severity, file_path, line, evidence, identity, src, file, lineo, item, txt"


def raw(axis, rule, severity, source, *, path="NULL", line="NULL", evidence="''", identity=None, src=0, file="0", lineo=None, item="0", txt="''"):
    return f"""SELECT repo, commit_sha, '{axis}' AS axis, {rule} AS rule, {severity} AS severity, CAST({path} AS VARCHAR) AS file_path,
      CAST({line} AS INTEGER) AS line, {evidence} AS evidence, {identity or evidence} AS identity, {src} AS src, CAST({file} AS BIGINT) AS file,
      coalesce({lineo or line}, 0) AS lineo, CAST({item} AS BIGINT) AS item, {txt} AS txt FROM {source}"""


MERGED = f"""ided AS (SELECT *, concat(axis, ':', rule, ':', coalesce(nullif(file_path, ''), '-'), ':', {sql_fingerprint('identity')}) AS id FROM raw),
  merged AS (SELECT *, {RANK} AS sev FROM (SELECT i.*, c.occurrences FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha, axis, id ORDER BY src, file, lineo, item, txt) AS rn FROM ided) i
    JOIN (SELECT repo, commit_sha, axis, id, CAST(count(DISTINCT concat(coalesce(CAST(line AS VARCHAR), '-'), '|', evidence)) AS INTEGER) AS occurrences FROM ided GROUP BY ALL) c
    USING (repo, commit_sha, axis, id) WHERE rn = 1)),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo, commit_sha, axis ORDER BY sev, src, file, lineo, item, txt) AS INTEGER) AS rank FROM merged)"""

SENSITIVE_FILES = f"named AS (SELECT *, {SENSITIVE} AS kind FROM files)"
SECRETS_RAW = (
    raw("secrets_detection", "kind", "'critical'", "named WHERE kind IS NOT NULL", path="path", evidence="path", src=0, file="ord")
    + " UNION ALL "
    + raw("secrets_detection", "rule", "severity", "secrets", path="path", line="line_no", evidence="evidence", src=1, file="ord")
)
SECRETS_CTE = f"{FILES}, {LINES}, {SECRETS}, {SENSITIVE_FILES}"
SHOWN = "repo, commit_sha, axis, id, rule, severity, file_path, line, evidence, occurrences, rank"


def shown(found, limit=rules.MAX_FINDINGS_PER_AXIS):
    kept = findings.rank_findings(findings.merge_findings(found), limit)
    return kept.select(*[c.strip() for c in SHOWN.split(",")])


def axis_sql(ctes: str, raw_sql: str, limit: int = rules.MAX_FINDINGS_PER_AXIS) -> str:
    return f"WITH {ctes}, raw AS ({raw_sql}), {MERGED} SELECT {SHOWN} FROM ranked WHERE rank <= {limit}"


@query(
    f"""WITH {SECRETS_CTE}, raw AS ({SECRETS_RAW}), {MERGED}, counted AS (SELECT repo, commit_sha, count(*) AS n FROM merged GROUP BY ALL)
    SELECT s.repo, s.commit_sha, 'secrets_detection' AS axis, CASE WHEN c.n > 0 THEN 'issues_found' ELSE 'clean' END AS status,
      least(coalesce(c.n, 0), 4) AS kept, greatest(coalesce(c.n, 0) - 4, 0) AS dropped
    FROM (SELECT DISTINCT repo, commit_sha FROM files) s LEFT JOIN counted c USING (repo, commit_sha)"""
)
def secrets_axis(spark, sf_dir):
    corpus = files(spark, sf_dir)
    merged = findings.merge_findings(scan.secrets_axis(corpus, secret_rules=RULES))
    scopes = scan.scopes_of(tracked(spark, sf_dir))
    return findings.axis_statuses(scopes, findings.axis_counts(merged, 4), ["secrets_detection"])


@query(axis_sql(SECRETS_CTE, SECRETS_RAW, 4))
def secrets_findings(spark, sf_dir):
    return shown(scan.secrets_axis(files(spark, sf_dir), secret_rules=RULES), 4)


@query(
    f"WITH {FILES}, {SENSITIVE_FILES}, raw AS ({raw('secrets_detection', 'kind', chr(39) + 'critical' + chr(39), 'named WHERE kind IS NOT NULL', path='path', evidence='path', file='ord')}), {MERGED} SELECT repo, commit_sha, id, severity FROM merged"
)
def sensitive_files(spark, sf_dir):
    from assayer.operators.secrets import scan_sensitive_files

    return scan_sensitive_files(files(spark, sf_dir)).select(*K, "id", "severity")


@query(
    f"""WITH {SECRETS_CTE}, raw AS ({SECRETS_RAW}), {MERGED}, places AS (SELECT DISTINCT repo, commit_sha, axis, id, line, evidence FROM ided)
    SELECT m.repo, m.commit_sha, m.id, m.occurrences, string_agg(concat(coalesce(CAST(p.line AS VARCHAR), '-'), '=', p.evidence), chr(10) ORDER BY p.line) AS locations
    FROM merged m JOIN places p USING (repo, commit_sha, axis, id) GROUP BY ALL"""
)
def merged_locations(spark, sf_dir):
    merged = findings.merge_findings(scan.secrets_axis(files(spark, sf_dir), secret_rules=RULES))
    place = F.transform(
        "locations",
        lambda p: F.concat(F.coalesce(p["line"].cast("string"), F.lit("-")), F.lit("="), p["evidence"]),
    )
    return merged.select(*K, "id", "occurrences", F.array_join(place, "\n").alias("locations"))


# --- documentation ------------------------------------------------------------------------

DOCS_CTE = f"""{FILES}, {LINES}, {LINKS}, {RESOLVED}, {ENV_READS}, {FIRST_USE}, {DECLARED}, {MENTIONED},
  broken AS (SELECT r.* FROM (SELECT * REPLACE (resolved AS path), path AS doc FROM resolved WHERE resolved IS NOT NULL) r
    WHERE {ALLOWED} AND NOT EXISTS (SELECT 1 FROM paths f WHERE f.repo = r.repo AND f.commit_sha = r.commit_sha AND f.path = r.path)),
  undocumented AS (SELECT * FROM first_use u WHERE name NOT IN {sql_list(rules.PLATFORM_ENV)}
    AND NOT EXISTS (SELECT 1 FROM declared d WHERE (d.repo, d.commit_sha, d.name) = (u.repo, u.commit_sha, u.name))
    AND NOT EXISTS (SELECT 1 FROM mentioned d WHERE (d.repo, d.commit_sha, d.name) = (u.repo, u.commit_sha, u.name))),
  unused AS (SELECT * FROM declared u WHERE name NOT IN {sql_list(rules.PLATFORM_ENV)}
    AND NOT EXISTS (SELECT 1 FROM first_use d WHERE (d.repo, d.commit_sha, d.name) = (u.repo, u.commit_sha, u.name))),
  templates AS (SELECT DISTINCT repo, commit_sha FROM paths WHERE {NAME} IN {sql_list(rules.ENV_TEMPLATE_NAMES)}),
  no_template AS (SELECT repo, commit_sha, count(*) AS env_used FROM first_use ANTI JOIN templates USING (repo, commit_sha) GROUP BY ALL HAVING count(*) >= 3),
  documented AS (SELECT DISTINCT repo, commit_sha FROM files WHERE {MARKDOWN})"""
DOCS_RAW = " UNION ALL ".join(
    [
        raw("readme_check", "'docs.broken_link'", "'medium'", "broken", path="doc", line="line_no", evidence="target", identity="path", src=0, file="ord", item="link_pos"),
        raw("readme_check", "'docs.undocumented_env'", "'medium'", "undocumented", path="path", line="line_no", evidence="name", src=1, lineo="0", txt="name"),
        raw("readme_check", "'docs.unused_env'", "'low'", "unused", evidence="name", src=2, txt="name"),
        raw("readme_check", "'docs.no_env_example'", "'medium'", "no_template", src=3),
    ]
)
DOCS_RAW = f"SELECT * FROM ({DOCS_RAW}) SEMI JOIN documented USING (repo, commit_sha)"


DOC_METRICS = f"""doc_metrics AS (SELECT s.*, (SELECT count(*) FROM files f WHERE (f.repo, f.commit_sha) = (s.repo, s.commit_sha) AND {MARKDOWN}) AS documents,
      (SELECT count(*) FROM first_use u WHERE (u.repo, u.commit_sha) = (s.repo, s.commit_sha)) AS env_used,
      (SELECT count(*) FROM declared u WHERE (u.repo, u.commit_sha) = (s.repo, s.commit_sha)) AS env_declared
    FROM (SELECT repo, commit_sha, bool_or({NAME} IN {sql_list(rules.ENV_TEMPLATE_NAMES)}) AS has_env_example FROM paths GROUP BY ALL) s)"""


@query(axis_sql(DOCS_CTE, DOCS_RAW, 6))
def docs_axis(spark, sf_dir):
    return shown(scan.docs_axis(files(spark, sf_dir), tracked(spark, sf_dir)), 6)


def _env(spark, sf_dir):
    hits = lines.line_hits(files(spark, sf_dir), ("env", "declared", "tokens"))
    used = documents.first_usage(documents.env_usage(hits))
    return used, documents.env_declared(hits), documents.doc_mentions(hits)


@query(f"WITH {DOCS_CTE} SELECT ord, CAST(line_no AS INTEGER) AS line_no, target, path AS resolved FROM broken")
def broken_links(spark, sf_dir):
    links = documents.extract_links(lines.line_hits(files(spark, sf_dir), ("links",)))
    return documents.broken_links(links, tracked(spark, sf_dir)).select("ord", "line_no", "target", "resolved")


@query(f"WITH {DOCS_CTE} SELECT repo, commit_sha, name, path, CAST(line_no AS INTEGER) AS line_no FROM undocumented")
def undocumented_env(spark, sf_dir):
    return documents.undocumented_env(*_env(spark, sf_dir))


@query(f"WITH {DOCS_CTE} SELECT repo, commit_sha, name FROM unused")
def unused_env(spark, sf_dir):
    used, declared, _ = _env(spark, sf_dir)
    return documents.unused_env(declared, used)


@query(f"WITH {DOCS_CTE} SELECT repo, commit_sha, env_used FROM no_template")
def missing_env_template(spark, sf_dir):
    used, _, _ = _env(spark, sf_dir)
    return documents.missing_env_template(used, C.repo_flags(tracked(spark, sf_dir)))


@query(
    f"""WITH {DOCS_CTE}, {DOC_METRICS} SELECT *, documents > 0 AS available FROM doc_metrics"""
)
def doc_metrics(spark, sf_dir):
    used, declared, _ = _env(spark, sf_dir)
    flags = C.repo_flags(tracked(spark, sf_dir))
    return documents.doc_metrics(files(spark, sf_dir), flags, used, declared)


# --- quality ------------------------------------------------------------------------------

LINT_RAW = LINT_RAW_OF(raw)


def _owner(column: str, table: dict[str, list[str]]) -> str:
    return sql_map({entry: eco for eco, entries in table.items() for entry in entries}, column)


QUALITY_CTE = f"""{FILES}, {LINES}, {REQUIREMENTS},
  detected AS (SELECT DISTINCT repo, commit_sha, eco AS ecosystem FROM (SELECT repo, commit_sha, unnest([{_owner(NAME, rules.MANIFESTS)}, {_owner(SUFFIX, rules.SOURCE_EXTENSIONS)}]) AS eco FROM paths) WHERE eco IS NOT NULL),
  locked AS (SELECT DISTINCT repo, commit_sha, {_owner(NAME, rules.LOCKFILES)} AS ecosystem FROM paths),
  unlocked AS (SELECT * FROM detected d WHERE ecosystem IN {sql_list(list(rules.LOCKFILES))}
    AND NOT EXISTS (SELECT 1 FROM locked l WHERE (l.repo, l.commit_sha, l.ecosystem) = (d.repo, d.commit_sha, d.ecosystem))),
  manifests AS (SELECT repo, commit_sha, ord, path, count(*) FILTER (WHERE requirement = 'pinned') AS pinned, count(*) AS total FROM requirements GROUP BY ALL),
  judged AS (SELECT *, total >= 3 AND pinned / total < 0.8 AS unpinned FROM manifests),
  pinned_repos AS (SELECT DISTINCT repo, commit_sha FROM judged WHERE total >= 3 AND NOT unpinned),
  flags AS (SELECT repo, commit_sha, bool_or({SUFFIX} IN {sql_list(rules.ALL_SOURCE_EXTENSIONS)}) AS has_sources, bool_or({TEST_PATH}) AS has_tests, bool_or({CI_PATH}) AS has_ci FROM paths GROUP BY ALL)"""
SOFT = "(ecosystem = 'python' AND EXISTS (SELECT 1 FROM pinned_repos p WHERE (p.repo, p.commit_sha) = (unlocked.repo, unlocked.commit_sha)))"
QUALITY_RAW = " UNION ALL ".join(
    [
        raw("quality_check", "'quality.no_tests'", "'medium'", "flags WHERE has_sources AND NOT has_tests", src=2),
        raw("quality_check", "'quality.no_ci'", "'low'", "flags WHERE has_sources AND NOT has_ci", src=3),
        raw("quality_check", f"CASE WHEN {SOFT} THEN 'quality.pinned_without_lockfile' ELSE 'quality.no_lockfile' END",
            f"CASE WHEN {SOFT} THEN 'info' ELSE 'medium' END", "unlocked", identity="ecosystem", src=4, txt="ecosystem"),
        raw("quality_check", "'quality.unpinned_dependencies'", "'low'", "judged WHERE unpinned", path="path", src=5, file="ord"),
    ]
)


@query(axis_sql(QUALITY_CTE, QUALITY_RAW, 3))
def quality_axis(spark, sf_dir):
    return shown(scan.quality_axis(files(spark, sf_dir), tracked(spark, sf_dir)), 3)


@query(f"WITH {QUALITY_CTE} SELECT * FROM detected")
def ecosystems(spark, sf_dir):
    return quality.detect_ecosystems(tracked(spark, sf_dir))


@query(f"WITH {QUALITY_CTE} SELECT * FROM unlocked")
def missing_lockfiles(spark, sf_dir):
    return quality.missing_lockfiles(tracked(spark, sf_dir))


@query(f"WITH {QUALITY_CTE} SELECT repo, commit_sha, ord, path, pinned, total, unpinned FROM judged")
def pinning(spark, sf_dir):
    hits = lines.line_hits(files(spark, sf_dir), ("requirement",))
    return quality.pinning(hits).drop("judged")


@query(f"WITH {QUALITY_CTE} SELECT repo, commit_sha, bool_or(total >= 3 AND NOT unpinned) AS pinned_requirements FROM judged GROUP BY ALL")
def pinned_repos(spark, sf_dir):
    hits = lines.line_hits(files(spark, sf_dir), ("requirement",))
    return quality.pinned_repos(quality.pinning(hits))


# Each text becomes a Python file: its lines as comments, and a function with one ``if`` for every
# line of the text up to nine, then a body of a kind that the id picks.  Bodies come with their score;
# one does not parse, one is a sum of 1,500 terms, and one holds a function of its own.
BODIES = [
    ("    z = x\n", 0),
    ("    z = 1 if x else 2\n    for i in y:\n        z = i\n", 2),
    ("    while x:\n        x = None\n", 1),
    ("    try:\n        z = 1\n    except ValueError:\n        z = 2\n    except KeyError:\n        z = 3\n", 2),
    ("    match x:\n        case 1:\n            z = 1\n        case _:\n            z = 2\n", 2),
    ("    z = {i: j for i in y for j in i if i if j}\n", 4),
    ("    z = x and y and x or y\n", 3),
    ("    z = " + "1 + " * 1500 + "1\n", 0),
    ("    z = = 1\n", None),
    ("    async def g():\n        async for i in y:\n            z = [k for k in i if k]\n", 0),
    ("    class C:\n        z = 1 if x else 2\n    z = lambda a: a if a else x\n", 1),
]
IFS = "least(length(text) - length(replace(text, chr(10), '')), 9)"


def _bodies(quote) -> str:
    picked = " ".join(f"WHEN {i} THEN {quote(body)}" for i, (body, _) in enumerate(BODIES))
    return f"CASE doc_id % {len(BODIES)} {picked} END"


PYTHON = (
    "concat('# ', regexp_replace(regexp_replace(text, '[^ -~\\n]', '?'), '\\n', '\\n# '), chr(10), 'def f', CAST(doc_id AS STRING), '(x, y):', chr(10), "
    f"repeat(concat('    if x:', chr(10), '        x = y', chr(10)), CAST({IFS} AS INT)), "
    + _bodies(lambda body: "'" + body.replace("\n", "\\n") + "'")
    + ", '    return x', chr(10))"
)


def python_files(spark, sf_dir):
    from checks.registry import table

    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("repo"), F.col("lang").alias("commit_sha"), F.col("doc_id").alias("ord"),
        F.expr("concat('src/f', CAST(doc_id AS STRING), CASE WHEN lang = 'es' THEN '.js' ELSE '.py' END)").alias("path"),
        F.expr(PYTHON).alias("content"),
    )


_SCORE = "CASE doc_id % {n} {cases} END".format(
    n=len(BODIES),
    cases=" ".join(f"WHEN {i} THEN {'NULL' if score is None else score}" for i, (_, score) in enumerate(BODIES)),
)
# The lines of f, and where its inner function g stands: comments, f's own line, two per if.
SCORES = f"""bodies AS (SELECT source AS repo, lang AS commit_sha, doc_id AS ord, concat('src/f', doc_id, CASE WHEN lang = 'es' THEN '.js' ELSE '.py' END) AS path,
    doc_id, {IFS} AS ifs, length(text) - length(replace(text, chr(10), '')) + 1 AS comments, {_SCORE} AS body FROM documents),
  scores AS (SELECT repo, commit_sha, ord, path, concat('f', doc_id) AS name, CAST(comments + 1 AS INTEGER) AS line_no, CAST(1 + ifs + body AS INTEGER) AS score FROM bodies WHERE body IS NOT NULL
    UNION ALL SELECT repo, commit_sha, ord, path, 'g', CAST(comments + 2 + 2 * ifs AS INTEGER), 4 FROM bodies WHERE doc_id % {len(BODIES)} = 9)"""


@query(f"WITH {SCORES} SELECT repo, commit_sha, 'syntax' AS problem, count(*) AS n_files FROM bodies WHERE body IS NULL AND path LIKE '%.py' GROUP BY ALL")
def unparsed_sources(spark, sf_dir):
    return quality.unparsed_sources(python_files(spark, sf_dir))


@query(f"WITH {SCORES} SELECT ord, path, name, line_no, score FROM scores WHERE path LIKE '%.py'")
def function_complexity(spark, sf_dir):
    return quality.function_complexity(python_files(spark, sf_dir)).select(
        "ord", "path", "name", "line_no", "score"
    )


@query(
    f"""WITH {SCORES} SELECT repo, commit_sha, 10 AS threshold, count(score) FILTER (WHERE py) AS analyzed_functions,
      CASE WHEN bool_or(py) THEN count(*) FILTER (WHERE score > 10) END AS over_threshold, CASE WHEN bool_or(py) THEN max(score) END AS max,
      CASE WHEN bool_or(py) THEN round_even(avg(score), 1) END AS average, CASE WHEN bool_or(py) THEN 'python' ELSE '' END AS analyzed_languages,
      CASE WHEN bool_or(NOT py) THEN 'node' ELSE '' END AS unanalyzed_languages
    FROM (SELECT b.repo, b.commit_sha, s.score, b.path LIKE '%.py' AS py FROM bodies b LEFT JOIN scores s ON s.ord = b.ord AND s.path = b.path) GROUP BY ALL"""
)
def complexity_stats(spark, sf_dir):
    corpus = python_files(spark, sf_dir)
    stats = quality.complexity_stats(corpus, quality.function_complexity(corpus))
    joined = {c: F.array_join(c, ",") for c in ("analyzed_languages", "unanalyzed_languages")}
    return stats.withColumns(joined)


COMPLEX_RAW = raw("quality_check", "'quality.complex_function'", "CASE WHEN score > 20 THEN 'high' ELSE 'medium' END",
    "scores WHERE path LIKE '%.py' AND score > 10", path="path", line="line_no", evidence="concat('def ', name, '(...)')", src=1, file="ord", lineo="CASE name WHEN 'g' THEN 1 ELSE 0 END")


@query(axis_sql(SCORES, COMPLEX_RAW, 5))
def complexity_findings(spark, sf_dir):
    functions = quality.function_complexity(python_files(spark, sf_dir))
    return shown(quality.complexity_findings(functions), 5)


# --- ignore files -------------------------------------------------------------------------

# The rules that occur in the corpus, written out as regular expressions by hand.
KNOWN_RULES = {
    "*.log": ("^(.*/)?[^/]*[.]log/?$", False),
    "node_modules/": ("^(.*/)?node_modules/$", False),
    ".env*": ("^(.*/)?[.]env[^/]*/?$", False),
    "!.env.example": ("^(.*/)?[.]env[.]example/?$", True),
    "/deploy/": ("^deploy/$", False),
    "*.json": ("^(.*/)?[^/]*[.]json/?$", False),
    "!package.json": ("^(.*/)?package[.]json/?$", True),
    ".venv/": ("^(.*/)?[.]venv/$", False),
    "config/": ("^(.*/)?config/$", False),
    # a star stands for a part of a path, and parts are never empty
    "logs/*": ("^logs/[^/]+/?$", False),
    "!logs/f*7.log": ("^logs/f[^/]*7[.]log/?$", True),
    "/*": ("^[^/]+/?$", False),
    "!/src/": ("^src/$", True),
    "!/docs/": ("^docs/$", True),
    "build-[0-9]/": ("^(.*/)?build-[0-9]/$", False),
    "**/tmp/": ("^(.*/)?tmp/$", False),
    "__pycache__/": ("^(.*/)?__pycache__/$", False),
}
_VALUES = ", ".join(f"('{rule}', '{regex}', {str(neg).upper()})" for rule, (regex, neg) in KNOWN_RULES.items())
IGNORE_CTE = f"""{FILES}, {LINES},
  known(rule, regex, negated) AS (VALUES {_VALUES}),
  specs AS (SELECT repo, commit_sha, path, regexp_replace(path, '[.]gitignore$', '') AS base FROM files WHERE {NAME} = '.gitignore'),
  spec_rules AS (SELECT s.repo, s.commit_sha, s.base, l.line_no, k.regex, k.negated FROM specs s JOIN lines l USING (repo, commit_sha, path) JOIN known k ON k.rule = l.line)"""


def ignored_cte(name: str, source: str) -> str:
    """Ignored ``(repo, commit_sha, path)`` of ``source`` by walking every directory of a path."""
    return f"""{name}_candidates AS (SELECT repo, commit_sha, path, base, unnest(list_transform(range(1, len(p) + 1), lambda i:
        concat(array_to_string(p[1:i], '/'), CASE WHEN i < len(p) THEN '/' ELSE '' END))) AS candidate
      FROM (SELECT t.repo, t.commit_sha, t.path, s.base, string_split(substr(t.path, length(s.base) + 1), '/') AS p FROM {source} t
        JOIN specs s ON t.repo = s.repo AND t.commit_sha = s.commit_sha AND starts_with(t.path, s.base))),
  {name} AS (SELECT DISTINCT repo, commit_sha, path FROM (SELECT c.repo, c.commit_sha, c.path, c.base, c.candidate, arg_max(r.negated, r.line_no) AS negated
      FROM {name}_candidates c JOIN spec_rules r ON c.repo = r.repo AND c.commit_sha = r.commit_sha AND c.base = r.base AND regexp_matches(c.candidate, r.regex)
      GROUP BY ALL) WHERE NOT negated)"""


_SAMPLES = ", ".join(
    f"({i}, {'NULL' if e is None else repr(e)}, '{label}', '{sample}')"
    for i, (e, label, sample) in enumerate(ignore.expected_samples())
)
IGNORE_FULL = f"""{IGNORE_CTE}, {ignored_cte('ignored', 'paths')},
  states AS (SELECT f.repo, f.commit_sha, f.ord, f.path, {SENSITIVE.replace('path', 'f.path')} AS sensitive, i.path IS NOT NULL AS ignored
    FROM paths f SEMI JOIN specs USING (repo, commit_sha) LEFT JOIN ignored i ON (f.repo, f.commit_sha, f.path) = (i.repo, i.commit_sha, i.path)),
  samples(position, ecosystem, label, sample) AS (VALUES {_SAMPLES}),
  detected AS (SELECT DISTINCT repo, commit_sha, eco AS ecosystem FROM (SELECT repo, commit_sha, unnest([{_owner(NAME, rules.MANIFESTS)}, {_owner(SUFFIX, rules.SOURCE_EXTENSIONS)}]) AS eco FROM paths) WHERE eco IS NOT NULL),
  laid AS (SELECT s.repo, s.commit_sha, p.position, p.label, concat(s.base, p.sample) AS path FROM specs s, samples p
    WHERE p.ecosystem IS NULL OR EXISTS (SELECT 1 FROM detected d WHERE (d.repo, d.commit_sha, d.ecosystem) = (s.repo, s.commit_sha, p.ecosystem))),
  {ignored_cte('sample_ignored', 'laid')},
  missing AS (SELECT l.repo, l.commit_sha, l.position, l.label FROM laid l LEFT JOIN sample_ignored i ON (l.repo, l.commit_sha, l.path) = (i.repo, i.commit_sha, i.path)
    GROUP BY ALL HAVING NOT bool_or(i.path IS NOT NULL)),
  scopes AS (SELECT DISTINCT repo, commit_sha FROM paths)"""
_TRACKED_RULE = f"CASE WHEN sensitive IS NOT NULL AND NOT ignored THEN 'gitignore.unprotected' ELSE 'gitignore.tracked_ignored' END"
IGNORE_RAW = " UNION ALL ".join(
    [
        raw("gitignore_check", "'gitignore.missing'", "'high'", "scopes ANTI JOIN specs USING (repo, commit_sha)"),
        raw("gitignore_check", _TRACKED_RULE, "CASE WHEN sensitive IS NOT NULL AND NOT ignored THEN 'critical' WHEN sensitive IS NOT NULL THEN 'high' ELSE 'medium' END",
            f"states WHERE (sensitive IS NOT NULL AND NOT ignored) OR (ignored AND {NAME} <> '.gitignore')", path="path", evidence="path", file="ord"),
        raw("gitignore_check", "'gitignore.rule_missing'", "'medium'", "missing", evidence="label", src=1, item="position"),
    ]
)


@query(f"WITH {IGNORE_FULL} SELECT * FROM ignored")
def ignored_paths(spark, sf_dir):
    return ignore.ignored_paths(tracked(spark, sf_dir), ignore.ignore_specs(files(spark, sf_dir)))


@query(f"WITH {IGNORE_FULL} SELECT ord, path, sensitive, ignored FROM states")
def path_states(spark, sf_dir):
    states = ignore.path_states(tracked(spark, sf_dir), ignore.ignore_specs(files(spark, sf_dir)))
    return states.select("ord", "path", "sensitive", "ignored")


@query(f"WITH {IGNORE_FULL} SELECT repo, commit_sha, CAST(position AS INTEGER) AS position, label FROM missing")
def missing_ignore_rules(spark, sf_dir):
    specs = ignore.ignore_specs(files(spark, sf_dir))
    return ignore.missing_ignore_rules(specs, quality.ecosystem_facts(tracked(spark, sf_dir)))


@query(axis_sql(IGNORE_FULL, IGNORE_RAW, 4))
def ignore_axis(spark, sf_dir):
    return shown(scan.ignore_axis(files(spark, sf_dir), tracked(spark, sf_dir)), 4)


IGNORE_METRICS = f"""rule_lines AS (SELECT repo, commit_sha, count(*) AS n FROM lines WHERE {NAME} = '.gitignore'
      AND trim(line) <> '' AND NOT starts_with(trim(line), '#') GROUP BY ALL),
    ignore_metrics AS (SELECT s.repo, s.commit_sha, (SELECT count(*) FROM specs x WHERE (x.repo, x.commit_sha) = (s.repo, s.commit_sha)) AS gitignore_files,
      coalesce((SELECT n FROM rule_lines x WHERE (x.repo, x.commit_sha) = (s.repo, s.commit_sha)), 0) AS rules,
      (SELECT count(*) FROM raw x WHERE (x.repo, x.commit_sha) = (s.repo, s.commit_sha) AND rule = 'gitignore.tracked_ignored') AS tracked_but_ignored,
      (SELECT count(*) FROM raw x WHERE (x.repo, x.commit_sha) = (s.repo, s.commit_sha) AND rule = 'gitignore.unprotected') AS unprotected FROM scopes s)"""


@query(f"WITH {IGNORE_FULL}, raw AS ({IGNORE_RAW}), {IGNORE_METRICS} SELECT * FROM ignore_metrics")
def ignore_metrics(spark, sf_dir):
    corpus, rows = files(spark, sf_dir), tracked(spark, sf_dir)
    specs = ignore.ignore_specs(corpus)
    found = ignore.tracked_findings(ignore.path_states(rows, specs))
    return ignore.ignore_metrics(scan.scopes_of(rows), specs, found)


# --- all axes -----------------------------------------------------------------------------

SCAN_LIMIT = 6
# Besides the files made of texts every document is a Python file that can be parsed, or nearly.
MADE = 1_000_000_000
_SQL_PYTHON = f"""concat('# ', regexp_replace(regexp_replace(text, '[^ -~' || chr(10) || ']', '?', 'g'), chr(10), chr(10) || '# ', 'g'), chr(10), 'def f', doc_id, '(x, y):', chr(10),
    repeat(concat('    if x:', chr(10), '        x = y', chr(10)), CAST({IFS} AS INT)), replace({_bodies(lambda body: "'" + body.replace(chr(10), '~') + "'")}, '~', chr(10)), '    return x', chr(10))"""
MIXED = f"""base_files AS (SELECT {BASE} FROM documents), files AS (SELECT repo, commit_sha, ord, path, content FROM base_files
    UNION ALL SELECT source, lang, doc_id + {MADE}, concat('made/f', doc_id, '.py'), {_SQL_PYTHON} FROM documents), {PATHS}"""
PREPARED_CAP = 300
PREPARED = f"""base_files AS (SELECT {BASE} FROM documents), {TREE.replace('FROM files', 'FROM base_files')}, {KEPT.replace(f'place <= {CAP}', f'place <= {PREPARED_CAP}')},
  files AS (SELECT repo, commit_sha, ord, path, CASE WHEN outcome = 'empty_files' THEN '' ELSE content END AS content FROM kept WHERE outcome IS NULL OR outcome = 'empty_files'),
  paths AS (SELECT repo, commit_sha, ord, path FROM tracked)"""


def mixed_files(spark, sf_dir):
    made = python_files(spark, sf_dir)
    number = F.col("ord").cast("string")
    made = made.select(*K, (F.col("ord") + MADE).alias("ord"), F.concat(F.lit("made/f"), number, F.lit(".py")).alias("path"), "content")
    return files(spark, sf_dir).select(*K, "ord", "path", "content").unionByName(made)


_ALL = f"""{DOCS_CTE}, {SECRETS}, {SENSITIVE_FILES},
  {QUALITY_CTE.split(LINES + ',')[1]},
  {IGNORE_FULL.split(LINES + ',')[1].replace('detected AS', 'detected_again AS')}"""
_STATUSES = f"""totals AS (SELECT repo, commit_sha, axis, count(*) AS n FROM merged GROUP BY ALL),
  statuses AS (SELECT s.repo, s.commit_sha, a.axis, least(coalesce(t.n, 0), {SCAN_LIMIT}) AS kept, greatest(coalesce(t.n, 0) - {SCAN_LIMIT}, 0) AS dropped, coalesce(g.complete, TRUE) AS complete,
      CASE WHEN a.axis = 'readme_check' AND d.repo IS NULL THEN 'unavailable' WHEN t.n > 0 THEN 'issues_found' WHEN coalesce(g.complete, TRUE) THEN 'clean' ELSE 'partial' END AS status
    FROM scopes s CROSS JOIN (SELECT unnest({rules.AXES}) AS axis) a LEFT JOIN totals t ON (t.repo, t.commit_sha, t.axis) = (s.repo, s.commit_sha, a.axis)
    LEFT JOIN gaps g ON (g.repo, g.commit_sha) = (s.repo, s.commit_sha) LEFT JOIN documented d ON (d.repo, d.commit_sha) = (s.repo, s.commit_sha))"""
_GAPS = "gaps AS (SELECT repo, commit_sha, NOT (tree_truncated OR capped_over_limit > 0 OR failures > 0) AS complete FROM coverage)"
_SCORED = SCORES.replace("concat('src/f', doc_id, CASE WHEN lang = 'es' THEN '.js' ELSE '.py' END)", "concat('made/f', doc_id, '.py')").replace("doc_id AS ord", f"doc_id + {MADE} AS ord")
_LINTED = f"""{lint_sql(rules.MAX_ISSUES_PER_LINTER)},
  numbered AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha ORDER BY tool DESC, ord) - 1 AS idx FROM capped WHERE rule <> 'C901')"""
SCAN_CTE = f"""{_ALL.replace(FILES, MIXED)}, {_SCORED}, {_LINTED}, {TREE.replace('FROM files', 'FROM base_files')}, {KEPT}, {COVERAGE},
  raw AS ({SECRETS_RAW} UNION ALL {IGNORE_RAW} UNION ALL {QUALITY_RAW} UNION ALL {COMPLEX_RAW} UNION ALL {LINT_RAW} UNION ALL {DOCS_RAW}), {MERGED}, {_GAPS}, {_STATUSES}"""
PREPARED_CTE = f"""{_ALL.replace(FILES, PREPARED)}, {COVERAGE.replace(f'eligible - {CAP}', f'eligible - {PREPARED_CAP}')},
  raw AS ({SECRETS_RAW} UNION ALL {IGNORE_RAW} UNION ALL {QUALITY_RAW} UNION ALL {DOCS_RAW}), {MERGED}, {_GAPS}, {_STATUSES}"""


def _scan(spark, sf_dir, with_catalog=False):
    corpus = materialize(mixed_files(spark, sf_dir), "corpus")
    paths = corpus.select(*K, "ord", "path")
    return scan.run_scan(
        corpus, paths, coverage_rows=prepared(spark, sf_dir).coverage, linter_reports=linter_reports(paths),
        secret_rules=RULES, limit=SCAN_LIMIT, catalog=catalog(spark) if with_catalog else None, lang="en",
    )


def _prepared_scan(spark, sf_dir):
    """From a listing and a stored payload table."""
    stored = P.open_payloads(spark, new_table_path(spark, "payloads"), buckets=16)
    rows = payloads(spark, sf_dir)
    P.store_payloads(stored, rows.filter("http_status = 404"))
    P.store_payloads(stored, rows)
    return scan.scan_repositories(
        tree(spark, sf_dir), stored, PREPARED_CAP, MAX_SIZE, GUARDS, secret_rules=RULES, limit=SCAN_LIMIT,
    )


@query(f"WITH {PREPARED_CTE} SELECT repo, commit_sha, axis, status, kept, dropped, complete FROM statuses")
def repository_scans(spark, sf_dir):
    """Listing and stored payloads to statuses: selected, capped, decoded once, audited."""
    return _prepared_scan(spark, sf_dir).statuses.drop("message")


@query(f"WITH {PREPARED_CTE} SELECT {SHOWN} FROM ranked WHERE rank <= {SCAN_LIMIT}")
def repository_findings(spark, sf_dir):
    return _prepared_scan(spark, sf_dir).findings.select(*[c.strip() for c in SHOWN.split(",")])


@query(f"WITH {SCAN_CTE} SELECT repo, commit_sha, axis, status, kept, dropped, complete FROM statuses")
def scan_statuses(spark, sf_dir):
    return _scan(spark, sf_dir).statuses.drop("message")


@query(f"WITH {SCAN_CTE} SELECT {SHOWN} FROM ranked WHERE rank <= {SCAN_LIMIT}")
def scan_findings(spark, sf_dir):
    return _scan(spark, sf_dir).findings.select(*[c.strip() for c in SHOWN.split(",")])


@query(
    f"""WITH {SCAN_CTE}, levels AS (SELECT repo, commit_sha, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
      count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info
      FROM ranked WHERE rank <= {SCAN_LIMIT} GROUP BY ALL)
    SELECT s.repo, s.commit_sha, CAST(sum(s.kept) AS BIGINT) AS findings, CAST(sum(s.dropped) AS BIGINT) AS dropped, coalesce(any_value(l.critical), 0) AS critical,
      coalesce(any_value(l.high), 0) AS high, coalesce(any_value(l.medium), 0) AS medium, coalesce(any_value(l.low), 0) AS low, coalesce(any_value(l.info), 0) AS info,
      coalesce(string_agg(s.axis, ',' ORDER BY list_position({rules.AXES}, s.axis)) FILTER (WHERE s.status = 'issues_found'), '') AS axes_with_issues
    FROM statuses s LEFT JOIN levels l ON (l.repo, l.commit_sha) = (s.repo, s.commit_sha) GROUP BY s.repo, s.commit_sha"""
)
def scan_summary(spark, sf_dir):
    summary = _scan(spark, sf_dir).summary
    return summary.withColumn("axes_with_issues", F.array_join("axes_with_issues", ","))


TITLES = """CASE rule WHEN 'committed.env' THEN concat(name, ' file committed to the repository') WHEN 'committed.ssh_key' THEN concat('SSH private key committed (', name, ')')
  WHEN 'committed.pem' THEN 'PEM certificate or private key committed' WHEN 'secret.connection_string' THEN 'Exposed connection string'
  WHEN 'secret.aws_key' THEN 'Exposed AWS access key' WHEN 'secret.openai_key' THEN 'Exposed OpenAI key' ELSE rule END"""


@query(
    f"""WITH {SECRETS_CTE}, raw AS ({SECRETS_RAW}), {MERGED} SELECT repo, commit_sha, id, {TITLES} AS title,
      CASE WHEN line IS NULL THEN 'This kind of file must never be versioned: it holds secrets by design. Remove it from the Git history and add it to .gitignore.'
        ELSE concat('Line ', line, ': secret detected by automated scan') END AS description
    FROM (SELECT *, regexp_extract(file_path, '([^/]*)$', 1) AS name FROM ranked WHERE rank <= 30)"""
)
def localized_findings(spark, sf_dir):
    from assayer.operators.localize import localize_findings

    merged = findings.merge_findings(scan.secrets_axis(files(spark, sf_dir), secret_rules=RULES))
    kept = findings.rank_findings(merged)
    return localize_findings(kept, catalog(spark), F.lit("en")).select(*K, "id", "title", "description")


@query(
    f"""WITH {SECRETS_CTE}, raw AS ({SECRETS_RAW}), {MERGED} SELECT repo, commit_sha, id, CASE WHEN severity = 'info' THEN 'low' ELSE severity END AS severity,
    coalesce(file_path, 'N/A') AS file_path, evidence AS code_hint, occurrences FROM ranked WHERE rank <= 4"""
)
def stored_issues(spark, sf_dir):
    merged = findings.merge_findings(scan.secrets_axis(files(spark, sf_dir), secret_rules=RULES))
    issues = findings.legacy_issue(findings.rank_findings(merged, 4))
    return issues.select(*K, "id", "severity", "file_path", "code_hint", "occurrences")


@query(
    f"""WITH {SECRETS_CTE}, raw AS ({SECRETS_RAW}), {MERGED} SELECT repo, commit_sha, count(*) FILTER (WHERE severity = 'critical') AS critical,
    count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
    count(*) FILTER (WHERE severity = 'info') AS info FROM merged WHERE rule <> 'committed.pem' GROUP BY ALL"""
)
def severity_histogram(spark, sf_dir):
    found = scan.secrets_axis(files(spark, sf_dir), secret_rules=RULES)
    return findings.severity_counts(findings.merge_findings(findings.drop_rules(found, ["committed.pem"])))


_DELTA = f"""sides AS (SELECT *, CASE WHEN commit_sha = 'en' THEN 'before' ELSE 'after' END AS side, {sql_fingerprint('line')} AS fp FROM lines)"""


@query(
    f"""WITH {FILES}, {LINES}, {_DELTA} SELECT fp, CASE WHEN bool_and(side = 'before') THEN 'removed' WHEN bool_and(side = 'after') THEN 'added' ELSE 'unchanged' END AS change
    FROM sides GROUP BY fp"""
)
def finding_delta(spark, sf_dir):
    from assayer.functions import text as T

    rows = lines.explode_lines(files(spark, sf_dir)).select("commit_sha", T.fingerprint("line").alias("fp"))
    before, after = rows.filter(F.col("commit_sha") == "en"), rows.filter(F.col("commit_sha") != "en")
    return findings.finding_delta(before, after, ["fp"])
