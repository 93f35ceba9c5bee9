"""Scalar text functions and line-level extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators import documents, lines, quality, secrets
from checks.corpus import (
    FILES, LINES, NAME, SUFFIX, columns, files, sql_fingerprint, sql_list, sql_strip,
)
from checks.paths import TEST_PATH
from checks.registry import query, table

# The documents hold tokens the fixed rules do not know; this one is ours, for the checks.
EXTRA_RULE = ("secret.hex_token", r'token\s*=\s*"[0-9a-f]{40}"', "medium")
RULES = [*rules.SECRET_RULES, EXTRA_RULE]


@query(f"WITH {FILES}, {LINES} SELECT ord, path, CAST(line_no AS INTEGER) AS line_no, line FROM lines")
def explode_lines(spark, sf_dir):
    return lines.explode_lines(files(spark, sf_dir)).select("ord", "path", "line_no", "line")


@query(
    f"""WITH {FILES} SELECT ord, CASE WHEN len(string_split(content, chr(10))) > 40 THEN 'skipped_too_many_lines'
    WHEN len(string_split(content, chr(10))) <= 3 AND length(content) > 300 THEN 'skipped_minified' END AS guard FROM files"""
)
def content_guard(spark, sf_dir):
    guard = T.content_guard("content", 40, 3, 300)
    return files(spark, sf_dir).select("ord", guard.alias("guard"))


def sql_secret_rule(c: str = "line") -> str:
    branches = " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p, _ in RULES)
    return f"CASE WHEN regexp_matches({c}, '(?i){rules.PLACEHOLDER_PATTERN}') THEN NULL {branches} END"


SECRET_SEVERITY = "CASE WHEN rule = 'secret.connection_string' THEN 'high' WHEN rule = 'secret.hex_token' THEN 'medium' ELSE 'critical' END"
SECRETS = f"""secrets AS (SELECT *, {SECRET_SEVERITY} AS severity, substr({sql_strip('line')}, 1, 200) AS evidence,
    CASE WHEN {TEST_PATH} THEN 'test' END AS context
  FROM (SELECT *, {sql_secret_rule()} AS rule FROM lines WHERE {NAME} NOT IN {sql_list(rules.ENV_TEMPLATE_NAMES)}) WHERE rule IS NOT NULL)"""


@query(
    f"""WITH {FILES}, {LINES}, {SECRETS} SELECT repo, commit_sha, path AS file_path, CAST(line_no AS INTEGER) AS line, rule, severity,
    evidence, context, concat('secrets_detection:', rule, ':', path, ':', {sql_fingerprint('evidence')}) AS id FROM secrets"""
)
def secret_lines(spark, sf_dir):
    found = secrets.scan_secrets(files(spark, sf_dir), RULES)
    return found.select(
        "repo", "commit_sha", "file_path", "line", "rule", "severity", "evidence", "context", "id"
    )


PAGE_LINES = r"""page_lines AS (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (
    SELECT page_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM (SELECT page_id,
      string_split_regex(html, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{0085}\x{2028}\x{2029}]') AS p FROM pages)))"""


@query(
    f"""WITH {PAGE_LINES} SELECT page_id, CAST(line_no AS INTEGER) AS line_no, CAST(length({sql_strip('line')}) AS INTEGER) AS n,
    {sql_fingerprint('line')} AS fp FROM page_lines"""
)
def page_line_fingerprints(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("repo"), F.lit("").alias("commit_sha"), F.col("page_id").alias("ord"),
        F.col("url").alias("path"), F.col("html").alias("content"),
    )
    return lines.explode_lines(pages).select(
        F.col("ord").alias("page_id"), "line_no", F.char_length(T.strip("line")).alias("n"),
        T.fingerprint("line").alias("fp"),
    )


MARKDOWN = f"{SUFFIX} IN {sql_list(rules.MARKDOWN_EXTENSIONS)}"
LINKS = f"""links AS (SELECT * FROM (SELECT repo, commit_sha, ord, path, line_no, unnest(t) AS target, generate_subscripts(t, 1) - 1 AS link_pos
  FROM (SELECT *, regexp_extract_all(line, '{rules.LINK_PATTERN}', 1) AS t FROM lines WHERE {MARKDOWN})))"""


@query(f"WITH {FILES}, {LINES}, {LINKS} SELECT ord, CAST(line_no AS INTEGER) AS line_no, CAST(link_pos AS INTEGER) AS link_pos, target FROM links")
def markdown_links(spark, sf_dir):
    hits = lines.line_hits(files(spark, sf_dir), ("links",))
    return documents.extract_links(hits).select("ord", "line_no", "link_pos", "target")


# Path folding in SQL: a recursive walk over the parts, nothing of the engine's fold.
RESOLVED = f"""joined AS (
    SELECT *, {sql_strip("split_part(split_part(target, '#', 1), '?', 1)")} AS cleaned FROM links),
  parts AS (SELECT *, string_split(CASE WHEN starts_with(cleaned, '/') THEN cleaned
      WHEN contains(path, '/') THEN concat(regexp_replace(path, '/[^/]*$', ''), '/', cleaned) ELSE cleaned END, '/') AS p FROM joined),
  resolved AS (SELECT * EXCLUDE (p), CASE WHEN cleaned = '' OR regexp_matches(lower(cleaned), '^(http://|https://|mailto:|tel:|data:|ftp://|//)') THEN NULL
      WHEN array_to_string(folded, '/') IN ('', '.') OR starts_with(array_to_string(folded, '/'), '..') THEN NULL
      ELSE array_to_string(folded, '/') END AS resolved FROM (
    SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(p, lambda x: [x])), lambda acc, x:
      CASE WHEN x[1] IN ('', '.') THEN acc
           WHEN x[1] = '..' AND len(acc) > 0 AND acc[len(acc)] <> '..' THEN acc[1:len(acc) - 1]
           ELSE list_concat(acc, x) END) AS folded FROM parts))"""


@query(f"WITH {FILES}, {LINES}, {LINKS}, {RESOLVED} SELECT ord, CAST(line_no AS INTEGER) AS line_no, CAST(link_pos AS INTEGER) AS link_pos, resolved FROM resolved")
def resolved_links(spark, sf_dir):
    hits = lines.line_hits(files(spark, sf_dir), ("links",))
    return documents.extract_links(hits).select(
        "ord", "line_no", "link_pos", P.resolve_link("path", "target").alias("resolved")
    )


def sql_env_reads() -> str:
    lists = ", ".join(
        f"list_transform(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}', 1), lambda n: {{'pattern': {i}, 'name': n}})"
        for i, p in enumerate(rules.ENV_READ_PATTERNS)
    )
    return f"flatten([{lists}])"


ENV_READS = f"""env_reads AS (SELECT repo, commit_sha, ord, path, line_no, r.pattern AS pattern, r.name AS name FROM (
    SELECT *, unnest({sql_env_reads()}) AS r FROM lines WHERE NOT {MARKDOWN} AND NOT {TEST_PATH})
  WHERE regexp_matches(r.name, '{rules.ENV_NAME_PATTERN}'))"""


@query(f"WITH {FILES}, {LINES}, {ENV_READS} SELECT ord, CAST(line_no AS INTEGER) AS line_no, CAST(pattern AS INTEGER) AS pattern, name FROM env_reads")
def env_reads(spark, sf_dir):
    hits = lines.line_hits(files(spark, sf_dir), ("env",))
    return documents.env_usage(hits).select("ord", "line_no", "pattern", "name")


FIRST_USE = """first_use AS (SELECT repo, commit_sha, name, path, line_no FROM (SELECT *, row_number() OVER (
  PARTITION BY repo, commit_sha, name ORDER BY ord, line_no, pattern) AS rn FROM env_reads) WHERE rn = 1)"""


@query(f"WITH {FILES}, {LINES}, {ENV_READS}, {FIRST_USE} SELECT repo, commit_sha, name, path, CAST(line_no AS INTEGER) AS line_no FROM first_use")
def first_env_use(spark, sf_dir):
    hits = lines.line_hits(files(spark, sf_dir), ("env",))
    return documents.first_usage(documents.env_usage(hits))


DECLARED = f"""declared AS (SELECT DISTINCT repo, commit_sha, name FROM (
  SELECT repo, commit_sha, regexp_extract({sql_strip('line')}, '{rules.ENV_DECLARATION_PATTERN}', 1) AS name
  FROM lines WHERE {NAME} IN {sql_list(rules.ENV_TEMPLATE_NAMES)} AND NOT starts_with({sql_strip('line')}, '#'))
  WHERE regexp_matches(name, '{rules.ENV_NAME_PATTERN}'))"""


@query(f"WITH {FILES}, {LINES}, {DECLARED} SELECT * FROM declared")
def env_declarations(spark, sf_dir):
    return documents.env_declared(lines.line_hits(files(spark, sf_dir), ("declared",)))


MENTIONED = rf"""mentioned AS (SELECT DISTINCT repo, commit_sha, name FROM (SELECT repo, commit_sha,
  unnest(string_split_regex(content, '[^\p{{L}}\p{{N}}_]+')) AS name FROM files WHERE {MARKDOWN}) WHERE regexp_matches(name, '{rules.ENV_NAME_PATTERN}'))"""


@query(f"WITH {FILES}, {MENTIONED} SELECT * FROM mentioned")
def doc_mentions(spark, sf_dir):
    return documents.doc_mentions(lines.line_hits(files(spark, sf_dir), ("tokens",)))


REQUIREMENTS = f"""requirements AS (SELECT repo, commit_sha, ord, path, line_no,
  CASE WHEN regexp_matches({sql_strip('line')}, '{rules.PINNED_REQUIREMENT}') THEN 'pinned' ELSE 'loose' END AS requirement
  FROM lines WHERE {NAME} = 'requirements.txt' AND NOT regexp_matches({sql_strip('line')}, '{rules.IGNORED_REQUIREMENT}'))"""


@query(f"WITH {FILES}, {LINES}, {REQUIREMENTS} SELECT ord, CAST(line_no AS INTEGER) AS line_no, requirement FROM requirements")
def requirement_lines(spark, sf_dir):
    hits = lines.line_hits(files(spark, sf_dir), ("requirement",))
    return hits.select("ord", "line_no", "requirement")


@query(
    f"""WITH {FILES}, {LINES} SELECT repo, commit_sha, path, CAST(count(*) FILTER (WHERE {sql_strip('line')} <> ''
    AND NOT starts_with({sql_strip('line')}, '#')) AS INTEGER) AS rule_count FROM lines WHERE {NAME} = '.gitignore' GROUP BY ALL"""
)
def ignore_rule_counts(spark, sf_dir):
    rule_lines = lines.ignore_rule_text(F.col("line"))
    ignore_files = files(spark, sf_dir).filter(P.path_name("path") == rules.IGNORE_FILE)
    return lines.explode_lines(ignore_files).groupBy("repo", "commit_sha", "path").agg(
        F.count(rule_lines).cast("int").alias("rule_count")
    )


# --- scalar functions over whole tables ---------------------------------------------------


@query(f"SELECT doc_id, {sql_fingerprint('text')} AS fp, {sql_strip('text')} = '' AS blank FROM documents")
def text_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.fingerprint("text").alias("fp"), T.is_blank("text").alias("blank"))


@query(
    f"""SELECT event_id, CASE WHEN event_type IN ('critical', 'high', 'medium', 'low', 'info') THEN event_type ELSE 'low' END AS known,
    list_position(['critical', 'high', 'medium', 'low', 'info'], sev) - 1 AS sev_rank,
    CASE WHEN sev = 'info' THEN 'low' ELSE sev END AS legacy
    FROM (SELECT *, ['critical', 'high', 'medium', 'low', 'info'][CAST(event_id % 5 AS INT) + 1] AS sev FROM events)"""
)
def severities(spark, sf_dir):
    levels = F.array(*[F.lit(s) for s in rules.SEVERITIES])
    events = table(spark, sf_dir, "events").withColumn(
        "sev", F.element_at(levels, (F.col("event_id") % 5).cast("int") + 1)
    )
    return events.select(
        "event_id",
        T.known_severity("event_type").alias("known"),
        T.severity_rank("sev").alias("sev_rank"),
        T.legacy_severity("sev").alias("legacy"),
    )


@query(
    """SELECT doc_id, CASE WHEN tag IN ('fr', 'en') THEN tag ELSE 'fr' END AS lang FROM (
    SELECT doc_id, split_part(lower(trim(CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN concat(lang, '-US')
      WHEN 2 THEN concat('  ', lang, '_FR ') ELSE lang END)).replace('_', '-'), '-', 1) AS tag FROM documents)"""
)
def language_tags(spark, sf_dir):
    raw = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN concat(lang, '-US') "
        "WHEN 2 THEN concat('  ', lang, '_FR ') ELSE lang END"
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_lang(raw).alias("lang"))


@query(
    """SELECT doc_id, substr(text, 1, 200) AS evidence, substr(text, 1, 400) AS reason,
    CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS hint,
    substr(md5(text), 1, 7) AS short_sha FROM documents"""
)
def truncations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.truncate("text", rules.MAX_EVIDENCE_LENGTH).alias("evidence"),
        T.truncate("text", rules.MAX_REASON_LENGTH).alias("reason"),
        T.truncate("text", 100, "...").alias("hint"),
        T.truncate(F.md5("text"), 7).alias("short_sha"),
    )


@query(
    f"""SELECT conv_id, turn, coalesce(CASE WHEN role <> 'system' THEN NULL ELSE role END, CASE WHEN {sql_strip('a')} <> '' THEN a END,
    CASE WHEN {sql_strip('text')} <> '' THEN text END) AS shown
    FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN '  ' ELSE concat(role, '!') END AS a FROM conversations)"""
)
def first_texts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn(
        "a", F.when(F.col("turn") % 2 == 0, F.lit("  ")).otherwise(F.concat("role", F.lit("!")))
    )
    system = F.when(F.col("role") == "system", F.col("role"))
    return turns.select("conv_id", "turn", T.first_text(system, "a", "text").alias("shown"))


@query(
    """SELECT event_id, replace(replace('Ligne {line} : {name} {other}', '{line}', CAST(user_id AS VARCHAR)), '{name}', event_type) AS message
    FROM events"""
)
def filled_templates(spark, sf_dir):
    params = F.create_map(
        F.lit("line"), F.col("user_id").cast("string"), F.lit("name"), F.col("event_type")
    )
    filled = T.fill_template(F.lit("Ligne {line} : {name} {other}"), params, ["line", "name", "other"])
    return table(spark, sf_dir, "events").select("event_id", filled.alias("message"))


@query(
    """SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day_start,
    strftime(date_trunc('second', ts) + INTERVAL 20 MINUTE, '%Y-%m-%d %H:%M:%S') AS in_20_minutes,
    strftime(date_trunc('second', ts) + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS in_7_days,
    strftime(CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events"""
)
def clock_functions(spark, sf_dir):
    def shown(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    ts = F.col("ts").cast("timestamp")
    second = F.date_trunc("second", ts)
    zone = F.expr("CASE event_id % 3 WHEN 0 THEN '+02:00' WHEN 1 THEN 'Z' ELSE '' END")
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select(
        "event_id",
        shown(T.start_of_day(ts)).alias("day_start"),
        shown(T.later(second, minutes=20)).alias("in_20_minutes"),
        shown(T.later(second, days=7)).alias("in_7_days"),
        shown(T.parse_utc(text)).alias("parsed"),
    )


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / l_quantity, 4) AS d4, round_even(l_extendedprice / l_quantity, 2) AS d2, round_even(l_extendedprice / l_quantity, 1) AS d1 FROM lineitem")
def roundings(spark, sf_dir):
    ratio = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        *[T.round_to(ratio, n).alias(f"d{n}") for n in (4, 2, 1)],
    )
