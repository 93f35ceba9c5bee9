"""Linter reports on the files of a corpus, and what becomes of them in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import rules
from checks.corpus import sql_strip

CODES = ["F401", "C901", "XYZ9", "E722", "F841"]
JS_RULES = ["eqeqeq", "no-var", "unknown-rule", "no-empty", "no-unreachable"]


def linter_reports(paths):
    """One report per file, in the shape of either tool."""
    n = F.col("ord")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (n % 5).cast("int") + 1)
    js = F.element_at(F.array(*[F.lit(c) for c in JS_RULES]), (n % 5).cast("int") + 1)
    line = (n % 6 + 1).cast("int")
    message = F.concat(F.lit("m"), n.cast("string"))
    ruff = F.array(
        F.struct(
            code.alias("code"), F.col("path").alias("filename"), F.struct(line.alias("row")).alias("location"), message.alias("message")
        )
    )
    eslint = F.array(
        F.struct(
            F.col("path").alias("filePath"),
            F.array(F.struct(js.alias("ruleId"), line.alias("line"), message.alias("message"))).alias("messages"),
        )
    )
    is_ruff = F.floor(n / 20) % 2 == 0
    return paths.select(
        "repo", "commit_sha",
        n.alias("report_ord"),
        F.when(is_ruff, F.lit("ruff")).otherwise(F.lit("eslint")).alias("tool"),
        F.when(is_ruff, F.to_json(ruff)).otherwise(F.to_json(eslint)).alias("report"),
    )


def lint_sql(limit: int) -> str:
    return f"""issues AS (SELECT *, CASE rule {' '.join(f"WHEN '{r}' THEN '{s}'" for r, s in {**rules.RUFF_RULES, **rules.ESLINT_RULES}.items())} ELSE 'low' END AS severity FROM (
    SELECT repo, commit_sha, ord, path, content, CAST(ord % 6 + 1 AS INTEGER) AS line, concat('m', ord) AS message,
      CASE WHEN floor(ord / 20) % 2 = 0 THEN 'ruff' ELSE 'eslint' END AS tool,
      CASE WHEN floor(ord / 20) % 2 = 0 THEN {CODES}[ord % 5 + 1] ELSE {JS_RULES}[ord % 5 + 1] END AS rule FROM files) WHERE rule <> 'unknown-rule'),
  capped AS (SELECT *, coalesce({sql_strip("string_split_regex(content, '\\r\\n|\\r|\\n')[line]")}, '') AS code_hint FROM
    (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha, tool ORDER BY ord) AS rn FROM issues) WHERE rn <= {limit})"""


def LINT_RAW_OF(raw):
    return raw("quality_check", "rule", "severity", "numbered", path="path", line="line", evidence="code_hint",
        identity="CASE WHEN code_hint <> '' THEN code_hint ELSE concat(rule, '#', idx) END", lineo="0", item="idx")
