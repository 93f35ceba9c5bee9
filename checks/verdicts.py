"""Model answers: validation, application, merge, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import rules
from assayer.operators import findings, localize, verdicts
from assayer.plans import deepen
from assayer.sources import answers as A
from checks.registry import query, table

SCOPE = ["repo", "commit_sha", "axis"]


def labelled(spark, sf_dir):
    """All documents; one without a label counts as good and not toxic."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumns(
        {
            "quality": F.coalesce("quality", F.lit(1)),
            "toxic": F.coalesce("toxic", F.lit(0)),
            "repo": F.col("source"),
            "commit_sha": F.col("doc_id").cast("string"),
            "axis": F.lit("secrets_detection"),
        }
    )


def issues(spark, sf_dir):
    """Three issues per document, the third without an id."""
    n = F.col("doc_id").cast("string")
    return labelled(spark, sf_dir).select(
        *SCOPE, F.posexplode(F.array(F.lit("a"), F.lit("b"), F.lit(""))).alias("place", "tag"), "doc_id", "text", "toxic"
    ).select(
        *SCOPE, "place",
        F.when(F.col("tag") != "", F.concat(F.lit("f"), n, F.lit("-"), "tag")).alias("id"),
        F.when(F.col("tag") == "a", F.lit("critical")).otherwise(F.lit("low")).alias("severity"),
        F.lit("rule.x").alias("rule"),
        F.concat(F.lit("src/"), n, F.lit(".py")).alias("file_path"),
        F.concat(F.lit("T"), n).alias("title"),
        F.col("text").alias("code_hint"),
        F.when(F.col("toxic") == 1, F.lit("test")).alias("context"),
        F.when(F.col("tag") == "a", F.array(F.struct(F.lit(3).alias("line"), F.lit("e").alias("evidence")), F.struct(F.lit(9).alias("line"), F.lit("e").alias("evidence"))))
        .otherwise(F.array(F.struct(F.lit(None).cast("int").alias("line"), F.lit("e").alias("evidence"))))
        .alias("locations"),
        F.lit("regex").alias("source"),
    )


def answers(spark, sf_dir):
    """One answer per document: most keep to the list, some break it in each possible way."""
    n = F.col("doc_id")
    verdict = F.when(F.col("quality") == 0, F.lit("false_positive")).otherwise(F.lit("confirmed"))

    def entry(tag, verdict):
        name = F.concat(F.lit("f"), n.cast("string"), F.lit(f"-{tag}"))
        return F.struct(name.alias("finding_id"), verdict.alias("verdict"), F.col("text").alias("reason"))

    second = F.when(n % 7 == 0, F.lit("zzz")).otherwise(F.lit("b"))
    entries = F.array(
        entry("a", verdict),
        F.struct(
            F.concat(F.lit("f"), n.cast("string"), F.lit("-"), second).alias("finding_id"),
            F.when(F.col("toxic") == 1, F.lit("perhaps")).otherwise(F.lit("uncertain")).alias("verdict"),
            F.col("text").alias("reason"),
        ),
        entry("a", F.lit("uncertain")),
    )
    body = F.to_json(F.struct(entries.alias("verdicts")))
    raw = (
        F.when(n % 11 == 0, F.concat(F.lit("sorry, "), "text"))
        .when(n % 17 == 0, F.lit('{"verdicts": []}'))
        .when(n % 19 == 0, F.lit('{"verdicts": ["x"]}'))
        .when(n % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return labelled(spark, sf_dir).select(*SCOPE, raw.alias("raw"))


GOOD = "toxic = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0"
LABELLED = f"""labelled AS (SELECT d.source AS repo, CAST(d.doc_id AS VARCHAR) AS commit_sha, 'secrets_detection' AS axis, d.doc_id, d.text, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  good AS (SELECT * FROM labelled WHERE {GOOD}),
  decided AS (SELECT repo, commit_sha, axis, concat('f', doc_id, '-a') AS finding_id, CASE WHEN quality = 0 THEN 'false_positive' ELSE 'confirmed' END AS verdict, substr(text, 1, 400) AS reason FROM good
    UNION ALL SELECT repo, commit_sha, axis, concat('f', doc_id, '-b'), 'uncertain', substr(text, 1, 400) FROM good),
  issues AS (SELECT repo, commit_sha, axis, doc_id, text, toxic, CASE tag WHEN '' THEN NULL ELSE concat('f', doc_id, '-', tag) END AS id, CASE WHEN tag = 'a' THEN 'critical' ELSE 'low' END AS severity, place
    FROM (SELECT *, unnest(['a', 'b', '']) AS tag, unnest([0, 1, 2]) AS place FROM labelled))"""


@query(f"WITH {LABELLED} SELECT * FROM decided")
def validated_verdicts(spark, sf_dir):
    allowed = verdicts.submitted(issues(spark, sf_dir))
    return verdicts.validate_verdicts(answers(spark, sf_dir), allowed)


@query(f"WITH {LABELLED} SELECT repo, commit_sha, axis, 0 AS call, CASE WHEN ({GOOD}) OR (doc_id % 17 = 0 AND doc_id % 11 <> 0) THEN 'accepted' ELSE 'error' END AS status FROM labelled")
def answer_statuses(spark, sf_dir):
    return verdicts.answer_statuses(answers(spark, sf_dir), verdicts.submitted(issues(spark, sf_dir)))


APPLIED = """applied AS (SELECT i.repo, i.commit_sha, i.axis, i.place, i.id, d.verdict, CASE WHEN d.verdict = 'false_positive' THEN i.severity END AS original_severity,
    CASE WHEN d.verdict = 'false_positive' THEN 'info' ELSE i.severity END AS severity
  FROM issues i LEFT JOIN decided d ON (d.repo, d.commit_sha, d.axis, d.finding_id) = (i.repo, i.commit_sha, i.axis, i.id))"""


@query(f"WITH {LABELLED}, {APPLIED} SELECT repo, commit_sha, axis, CAST(place AS INTEGER) AS place, id, verdict, severity, original_severity FROM applied")
def applied_verdicts(spark, sf_dir):
    found = issues(spark, sf_dir)
    decided = verdicts.validate_verdicts(answers(spark, sf_dir), verdicts.submitted(found))
    return verdicts.apply_verdicts(found, decided).select(*SCOPE, "place", "id", "verdict", "severity", "original_severity")


@query(
    f"""WITH {LABELLED}, {APPLIED} SELECT repo, commit_sha, CAST(place AS INTEGER) AS place, CASE WHEN verdict = 'false_positive' THEN 'dismissed' ELSE 'retained' END AS list,
    list_position(['critical', 'high', 'medium', 'low', 'info'], severity) - 1 AS severity_rank FROM applied"""
)
def verdict_lists(spark, sf_dir):
    found = issues(spark, sf_dir)
    decided = verdicts.validate_verdicts(answers(spark, sf_dir), verdicts.submitted(found))
    split = findings.split_by_verdict(verdicts.apply_verdicts(found, decided), SCOPE, [F.col("place")])
    return split.select("repo", "commit_sha", "place", "list", "severity_rank")


_LINE = """concat('- id=f', doc_id, '-', tag, ' | regle=rule.x | severite=', CASE WHEN tag = 'a' THEN 'critical' ELSE 'low' END, ' | fichier=src/', doc_id, '.py',
  CASE WHEN tag = 'a' THEN ' | lignes=3,9' ELSE '' END, CASE WHEN toxic = 1 THEN ' | context=test' ELSE '' END, ' | titre=T', doc_id, CASE WHEN text <> '' THEN concat(' | extrait=', text) ELSE '' END)"""


@query(
    f"""WITH {LABELLED} SELECT repo, commit_sha, axis, 0 AS call, concat('Sort these:', chr(10), chr(10), {_LINE.replace("tag", "'a'")}, chr(10), {_LINE.replace("tag", "'b'")}) AS prompt FROM labelled"""
)
def triage_prompts(spark, sf_dir):
    return verdicts.triage_prompts(issues(spark, sf_dir), "Sort these:")


@query("SELECT doc_id, concat('Compare with:', chr(10), text, chr(10), 'Answer in JSON.') AS prompt FROM documents")
def discovery_prompts(spark, sf_dir):
    contexts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"))
    template = "Compare with:\n{context}\nAnswer in JSON."
    return verdicts.discovery_prompts(contexts, template).select("doc_id", "prompt")


@query(
    f"""WITH {LABELLED}, calls AS (SELECT repo, commit_sha, axis, concat('- id=f', doc_id, '-', tag) AS id, rank, {_LINE} AS line FROM labelled, (VALUES ('a', 0), ('b', 1)) t(tag, rank))
    SELECT repo, commit_sha, axis, rank AS call, line AS prompt FROM calls"""
)
def triage_prompts_of_one(spark, sf_dir):
    """One issue to a call: what does not fit the first call goes into further ones."""
    return verdicts.triage_prompts(issues(spark, sf_dir), per_call=1)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('Qualité: ', text) WHEN lang = 'en' THEN concat('Docs: ', text, '.') ELSE concat('Docs en français: ', text) END AS prompt
    FROM documents WHERE doc_id % 3 <> 0"""
)
def discovery_prompts_by_axis(spark, sf_dir):
    """Templates by axis and language; one axis has no template and gets no prompt."""
    n = F.col("doc_id")
    axis = F.when(n % 3 == 0, F.lit("secrets_detection")).when(n % 2 == 0, F.lit("quality_check")).otherwise(F.lit("readme_check"))
    contexts = table(spark, sf_dir, "documents").select(
        "doc_id", axis.alias("axis"), F.col("lang").alias("language"), F.col("text").alias("context")
    )
    templates = {
        ("quality_check", "fr"): "Qualité: {context}", ("readme_check", "en"): "Docs: {context}.",
        ("readme_check", "fr"): "Docs en français: {context}",
    }
    return verdicts.discovery_prompts(contexts, templates).select("doc_id", "prompt")


def count_letters(prompts):
    return '{"status":"clean","issues":[],"length":' + prompts.str.len().astype(str) + "}"


@query("""SELECT doc_id, concat('{"status":"clean","issues":[],"length":', length(text), '}') AS raw, 'clean' AS status FROM documents""")
def scored_prompts(spark, sf_dir):
    """Prompts through a model that counts letters, and its answers parsed."""
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return A.parse_llm_issues(verdicts.score_prompts(prompts, count_letters)).select("doc_id", "raw", "status")


def llm_answers(spark, sf_dir):
    n = F.col("doc_id")
    issue = F.struct(
        F.lit("low").alias("severity"), F.concat(F.lit("T"), n.cast("string")).alias("title"),
        F.when(n % 3 != 0, F.lit("a.py")).alias("file_path"), F.col("text").alias("description"),
    )
    other = F.struct(
        F.lit("high").alias("severity"), F.lit("second").alias("title"), F.lit("b.py").alias("file_path"), F.lit("d").alias("description")
    )
    # a number, a text and an issue whose title is null stand between the two
    null = F.lit('{"severity":"low","title":null,"file_path":"c.py","description":"n"}')
    body = F.concat(
        F.lit('{"status":"issues_found","issues":['), F.to_json(issue), F.lit(',7,"text",'), null, F.lit(","),
        F.to_json(other), F.lit("]}"),
    )
    raw = (
        F.when(n % 5 == 0, F.concat(F.lit("```json"), body, F.lit("```")))
        .when(n % 7 == 0, F.concat(F.lit("{broken "), "text"))
        .when(n % 11 == 0, F.lit('{"status": "clean"}'))
        .otherwise(body)
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'issues_found' WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 11 = 0 THEN 'clean' ELSE 'issues_found' END AS status,
    CAST(CASE WHEN doc_id % 5 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0) THEN 0 WHEN doc_id % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS valid_issues,
    CASE WHEN doc_id % 5 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0) THEN NULL WHEN doc_id % 3 = 0 THEN 'n' ELSE text END AS first_description FROM documents"""
)
def parsed_answers(spark, sf_dir):
    parsed = A.parse_llm_issues(llm_answers(spark, sf_dir))
    return parsed.select(
        "doc_id", "status", F.size("issues").alias("valid_issues"),
        F.try_element_at("issues", F.lit(1))["description"].alias("first_description"),
    )


def scan_state(spark, sf_dir):
    """Stored issues, statuses, triaged lists and discoveries, one axis per document."""
    axis = F.element_at(F.array(*[F.lit(a) for a in rules.AXES]), (F.col("doc_id") % 4).cast("int") + 1)
    docs = labelled(spark, sf_dir).withColumn("axis", axis)
    n = F.col("doc_id").cast("string")
    base = docs.filter(F.col("quality") == 1).select(
        *SCOPE, F.concat(F.lit("base"), n).alias("id"), F.lit("a.py").alias("file_path"), F.lit("scan").alias("source")
    )
    statuses = docs.select(*SCOPE, F.when(F.col("quality") == 1, F.lit("issues_found")).otherwise(F.lit("partial")).alias("status"))
    triaged = docs.filter(F.col("toxic") == 1).select(
        *SCOPE, F.concat(F.lit("triaged"), n).alias("id"), F.lit("a.py").alias("file_path"), F.lit("scan").alias("source")
    )
    discovered = docs.select(
        *SCOPE, F.concat(F.lit("found"), n).alias("id"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("nowhere.py")).otherwise(F.lit("a.py")).alias("file_path"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("ruff")).otherwise(F.lit("llm")).alias("source"),
    )
    tracked = docs.select("repo", "commit_sha", F.lit("a.py").alias("path"))
    return base, statuses, triaged, discovered, tracked


MERGE_AI = f"""state AS (SELECT *, {rules.AXES}[doc_id % 4 + 1] AS ax FROM labelled),
  merged AS (SELECT repo, commit_sha, ax AS axis, concat(CASE WHEN doc_id % 4 < 2 AND toxic = 1 THEN 'triaged' ELSE 'base' END, doc_id) AS id FROM state WHERE quality = 1 OR (doc_id % 4 < 2 AND toxic = 1)
    UNION ALL SELECT repo, commit_sha, ax, concat('found', doc_id) FROM state WHERE doc_id % 4 >= 2 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0)"""


@query(f"WITH {LABELLED}, {MERGE_AI} SELECT * FROM merged")
def merged_issues(spark, sf_dir):
    merged, _ = verdicts.merge_ai(*scan_state(spark, sf_dir))
    return merged.select(*SCOPE, "id")


@query(
    f"""WITH {LABELLED}, {MERGE_AI} SELECT s.repo, s.commit_sha, s.ax AS axis, CASE WHEN count(m.id) > 0 THEN 'issues_found' WHEN any_value(s.quality) = 1 THEN 'issues_found' ELSE 'partial' END AS status, count(m.id) AS n_issues
    FROM state s LEFT JOIN merged m ON (m.repo, m.commit_sha, m.axis) = (s.repo, s.commit_sha, s.ax) GROUP BY s.repo, s.commit_sha, s.ax"""
)
def merged_statuses(spark, sf_dir):
    _, statuses = verdicts.merge_ai(*scan_state(spark, sf_dir))
    return statuses.select(*SCOPE, "status", "n_issues")


def answers_by_call(spark, sf_dir):
    """Two calls an axis, one issue in each; what is wrong with one leaves the other alone."""
    n, name = F.col("doc_id"), F.col("doc_id").cast("string")

    def answer(tag, verdict):
        entry = F.struct(
            F.concat(F.lit("f"), name, F.lit("-"), tag).alias("finding_id"), verdict.alias("verdict"), F.col("text").alias("reason")
        )
        return F.to_json(F.struct(F.array(entry).alias("verdicts")))

    decided = F.when(F.col("quality") == 0, F.lit("false_positive")).otherwise(F.lit("confirmed"))
    first = F.when(n % 17 == 0, F.lit('{"verdicts": []}')).otherwise(
        answer(F.lit("a"), F.when(F.col("toxic") == 1, F.lit("perhaps")).otherwise(decided))
    )
    # the second may only name its own issue
    second = F.when(n % 11 == 0, F.col("text")).otherwise(
        answer(F.when(n % 7 == 0, F.lit("a")).otherwise(F.lit("b")), F.lit("uncertain"))
    )
    return labelled(spark, sf_dir).select(*SCOPE, F.posexplode(F.array(first, second)).alias("call", "raw"))


BY_CALL = """by_call AS (SELECT repo, commit_sha, axis, concat('f', doc_id, '-a') AS finding_id, CASE WHEN quality = 0 THEN 'false_positive' ELSE 'confirmed' END AS verdict, substr(text, 1, 400) AS reason
    FROM labelled WHERE toxic = 0 AND doc_id % 17 <> 0
  UNION ALL SELECT repo, commit_sha, axis, concat('f', doc_id, '-b'), 'uncertain', substr(text, 1, 400) FROM labelled WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0)"""


@query(f"WITH {LABELLED}, {BY_CALL} SELECT * FROM by_call")
def verdicts_by_call(spark, sf_dir):
    sent = verdicts.submitted(issues(spark, sf_dir), per_call=1)
    return verdicts.validate_verdicts(answers_by_call(spark, sf_dir), sent)


@query(
    f"""WITH {LABELLED} SELECT repo, commit_sha, axis, call, CASE WHEN call = 0 AND toxic = 1 AND doc_id % 17 <> 0 OR call = 1 AND (doc_id % 11 = 0 OR doc_id % 7 = 0) THEN 'error' ELSE 'accepted' END AS status
    FROM labelled, (VALUES (0), (1)) t(call)"""
)
def statuses_by_call(spark, sf_dir):
    sent = verdicts.submitted(issues(spark, sf_dir), per_call=1)
    return verdicts.answer_statuses(answers_by_call(spark, sf_dir), sent)


def discoveries(spark, sf_dir):
    """What a model finds by itself, one issue per document; some on paths that do not exist."""
    n = F.col("doc_id").cast("string")
    return labelled(spark, sf_dir).select(
        "repo", "commit_sha", F.lit("quality_check").alias("axis"), F.concat(F.lit("own"), n).alias("id"),
        F.lit("medium").alias("severity"), F.lit("llm").alias("source"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("nowhere.py")).otherwise(F.concat(F.lit("src/"), n, F.lit(".py"))).alias("file_path"),
    )


def deepened(spark, sf_dir):
    found = issues(spark, sf_dir)
    docs = labelled(spark, sf_dir)
    statuses = docs.select(*SCOPE, F.lit("issues_found").alias("status")).unionAll(
        docs.select("repo", "commit_sha", F.lit("quality_check"), F.lit("clean"))
    )
    tracked = docs.select("repo", "commit_sha", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))
    return deepen.ai_merge(found, statuses, answers_by_call(spark, sf_dir), discoveries(spark, sf_dir), tracked, per_call=1)


@query(
    f"""WITH {LABELLED}, {BY_CALL} SELECT i.repo, i.commit_sha, i.axis, i.id, d.verdict, CASE WHEN d.verdict = 'false_positive' THEN 'info' ELSE i.severity END AS severity
    FROM issues i LEFT JOIN by_call d ON d.commit_sha = i.commit_sha AND d.finding_id = i.id
    UNION ALL SELECT repo, commit_sha, 'quality_check', concat('own', doc_id), NULL, 'medium' FROM labelled WHERE doc_id % 3 <> 0"""
)
def deepened_issues(spark, sf_dir):
    """Verdicts of two calls an axis and the model's own findings, merged into the scan."""
    return deepened(spark, sf_dir).issues.select(*SCOPE, "id", "verdict", "severity")


@query(
    f"""WITH {LABELLED} SELECT repo, commit_sha, axis, 'issues_found' AS status, 3 AS n_issues FROM labelled
    UNION ALL SELECT repo, commit_sha, 'quality_check', CASE WHEN doc_id % 3 <> 0 THEN 'issues_found' ELSE 'clean' END, CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END FROM labelled"""
)
def deepened_statuses(spark, sf_dir):
    return deepened(spark, sf_dir).statuses.select(*SCOPE, "status", "n_issues")


@query("SELECT conv_id, bool_and(turn < 1 OR (role = 'assistant' AND turn % 2 = 1)) AS all_failed FROM conversations GROUP BY conv_id")
def failed_agents(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    failed = (F.col("turn") < 1) | ((F.col("role") == "assistant") & (F.col("turn") % 2 == 1))
    status = F.when(failed, F.lit("error")).otherwise(F.lit("clean"))
    return verdicts.all_failed(turns.withColumn("status", status), ["conv_id"])


@query(
    """SELECT user_id, source, count(*) AS count, CASE WHEN source IN ('filename', 'regex') THEN 'high' ELSE 'medium' END AS priority,
    CASE source WHEN 'filename' THEN 'recommendation.committed_files' WHEN 'regex' THEN 'recommendation.regex_secrets' ELSE concat('recommendation.', source) END AS message_key,
    list_position(['filename', 'regex', 'ruff', 'eslint'], source) AS place
    FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 'filename' WHEN 'click' THEN 'regex' WHEN 'error' THEN 'ruff' WHEN 'signup' THEN 'eslint' ELSE 'llm' END AS source FROM events) WHERE source <> 'llm' GROUP BY user_id, source"""
)
def recommendations(spark, sf_dir):
    source = F.expr(
        "CASE event_type WHEN 'view' THEN 'filename' WHEN 'click' THEN 'regex' WHEN 'error' THEN 'ruff' WHEN 'signup' THEN 'eslint' ELSE 'llm' END"
    )
    events = table(spark, sf_dir, "events").withColumn("source", source)
    return localize.recommendations(events, ["user_id"])
