"""Model answers and event streams as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import text as T

ISSUE = (
    "struct<severity: string, title: string, file_path: string, description: string, "
    "code_hint: string, rule: string, source: string>"
)
# Members stay text first, so that one of another kind spoils only itself.
ANSWER = "struct<status: string, issues: array<string>>"
EVENT = "struct<event: string, step: string, message: string, result: string, status: string>"


def parse_llm_issues(raw: DataFrame) -> DataFrame:
    """Answers to ``status`` and valid ``issues``.

    Text that is no JSON object gives status ``error``.  An issue that is no object, or lacks the
    key of a required field, is dropped; a key with null is there.
    """
    clean = T.strip_fences("raw")
    good = T.is_json_object(clean)
    parsed = F.from_json(F.when(good, clean), ANSWER)

    required = F.array(*[F.lit(field) for field in sorted(rules.REQUIRED_ISSUE_FIELDS)])

    def whole(member):
        return F.coalesce(F.size(F.array_except(required, F.json_object_keys(member))) == 0, F.lit(False))

    members = F.filter(parsed["issues"], whole)
    issues = F.coalesce(
        F.transform(members, lambda member: F.from_json(member, ISSUE)), F.array().cast(f"array<{ISSUE}>")
    )
    return raw.withColumn(
        "status", F.when(good, F.coalesce(parsed["status"], F.lit("parsed"))).otherwise(F.lit("error"))
    ).withColumn("issues", issues)


def parse_events(lines: DataFrame) -> DataFrame:
    """``data: {json}`` lines of an event stream to typed events; other lines are dropped."""
    prefix = "data: "
    return (
        lines.filter(F.startswith("line", F.lit(prefix)))
        .withColumn("e", F.from_json(F.substring("line", len(prefix) + 1, 2_147_483_647), EVENT))
        .filter(F.col("e.event").isNotNull())
        .select(*[c for c in lines.columns if c != "line"], "e.*")
    )
