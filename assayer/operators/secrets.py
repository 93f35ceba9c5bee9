"""Leaked credentials in lines, and files that should not be committed at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators.findings import make_findings
from assayer.operators.lines import SecretRule, line_hits, secret_severity

AXIS = "secrets_detection"


def secret_findings(hits: DataFrame, secret_rules: list[SecretRule] | None = None) -> DataFrame:
    """Findings from lines with a ``secret_rule``; files under test paths keep that context."""
    secret_rules = rules.SECRET_RULES if secret_rules is None else secret_rules
    rule = F.col("secret_rule")
    return make_findings(
        hits.filter(rule.isNotNull()),
        axis=AXIS,
        rule=rule,
        severity=secret_severity(rule, secret_rules),
        source="regex",
        source_ord=1,
        file_path=F.col("path"),
        line=F.col("line_no"),
        evidence=T.truncate(T.strip("line"), rules.MAX_EVIDENCE_LENGTH),
        context=F.when(P.is_test_path("path"), F.lit("test")),
        params={"line": F.col("line_no")},
        file_ord=F.col("ord"),
    )


def scan_secrets(files: DataFrame, secret_rules: list[SecretRule] | None = None) -> DataFrame:
    return secret_findings(line_hits(files, ("secret",), secret_rules), secret_rules)


def scan_sensitive_files(files: DataFrame) -> DataFrame:
    named = files.withColumn("kind", P.classify_sensitive("path"))
    return make_findings(
        named.filter(F.col("kind").isNotNull()),
        axis=AXIS,
        rule=F.col("kind"),
        severity=F.lit("critical"),
        source="filename",
        source_ord=0,
        file_path=F.col("path"),
        evidence=F.col("path"),
        params={"name": P.path_name("path")},
        file_ord=F.col("ord"),
    )
