"""The finding algebra: identity, merge, rank, cap, status, summary, delta.

A finding row carries ``ord`` (source, file, line, item, text), the position at which a sequential
scan would have met it.  First-wins merges, stable ranking and caps are all defined on it, so
results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import text as T
from assayer.operators import KEY

NO_PARAMS = "cast(map() as map<string,string>)"
MERGE_KEY = [*KEY, "axis", "id"]
BODY = [
    "rule", "severity", "file_path", "line", "evidence", "source", "context", "title", "params",
]


def make_findings(
    df: DataFrame,
    *,
    axis: str,
    rule: Column,
    severity: Column,
    source: str = "scan",
    source_ord: int = 0,
    file_path: Column | None = None,
    line: Column | None = None,
    evidence: Column | None = None,
    identity: Column | None = None,
    context: Column | None = None,
    title: Column | None = None,
    params: dict[str, Column] | None = None,
    file_ord: Column | None = None,
    line_ord: Column | None = None,
    item: Column | None = None,
    order_text: Column | None = None,
) -> DataFrame:
    """Shape rows into findings and give each its content-based id.

    The line number is not part of the identity, so a finding survives a shift of lines.
    """
    null_text = F.lit(None).cast("string")
    evidence = F.lit("") if evidence is None else evidence
    file_path = null_text if file_path is None else file_path
    line = F.lit(None).cast("int") if line is None else line.cast("int")
    content = evidence if identity is None else identity
    if params:
        filled = F.create_map(
            *[part for name, value in params.items() for part in (F.lit(name), value.cast("string"))]
        )
    else:
        filled = F.expr(NO_PARAMS)
    ordinal = F.struct(
        F.lit(source_ord).alias("src"),
        (F.lit(0) if file_ord is None else file_ord).cast("long").alias("file"),
        F.coalesce(line if line_ord is None else line_ord, F.lit(0)).alias("line"),
        (F.lit(0) if item is None else item).cast("long").alias("item"),
        (F.lit("") if order_text is None else order_text).alias("text"),
    )
    return df.select(
        *KEY,
        F.lit(axis).alias("axis"),
        T.finding_id(F.lit(axis), rule, file_path, T.fingerprint(content)).alias("id"),
        rule.alias("rule"),
        T.known_severity(severity).alias("severity"),
        file_path.alias("file_path"),
        line.alias("line"),
        evidence.alias("evidence"),
        F.lit(source).alias("source"),
        (null_text if context is None else context).alias("context"),
        (null_text if title is None else title).alias("title"),
        filled.alias("params"),
        ordinal.alias("ord"),
    )


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def drop_rules(findings: DataFrame, names: list[str]) -> DataFrame:
    return findings.filter(~F.col("rule").isin(names))


def merge_findings(findings: DataFrame) -> DataFrame:
    """One row per id: the first occurrence plus its distinct locations in first-seen order.

    Repeats of one location are folded first, with map-side partial aggregation, so an id that
    occurs very often reaches the second step as few rows.  What is listed there are distinct
    lines of one file, which already fitted one row.
    """
    places = findings.groupBy(*MERGE_KEY, F.col("line").alias("at"), F.col("evidence").alias("seen")).agg(
        F.min("ord").alias("ord"), F.min_by(F.struct(*BODY), "ord").alias("body")
    )
    merged = places.groupBy(*MERGE_KEY).agg(
        F.min("ord").alias("ord"),
        F.min_by("body", "ord").alias("body"),
        F.array_sort(
            F.collect_list(F.struct("ord", F.col("at").alias("line"), F.col("seen").alias("evidence")))
        ).alias("places"),
    )
    return merged.select(
        *MERGE_KEY,
        "body.*",
        F.transform(
            "places", lambda p: F.struct(p["line"].alias("line"), p["evidence"].alias("evidence"))
        ).alias("locations"),
        F.size("places").alias("occurrences"),
        "ord",
    )


def rank_findings(
    findings: DataFrame, limit: int | None = rules.MAX_FINDINGS_PER_AXIS
) -> DataFrame:
    """Most severe first, ties in scan order; keep ``limit`` per axis (None: all).

    The limit on ``row_number`` becomes a group limit below the shuffle: every task sends at
    most ``limit`` rows per axis, however many findings one repository has.
    """
    order = Window.partitionBy(*KEY, "axis").orderBy(T.severity_rank("severity"), "ord")
    ranked = findings.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def head_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group in a given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def severity_counts(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One count per fixed level, zeros kept."""
    keys = KEY if keys is None else keys
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES]
    return findings.groupBy(*keys).agg(*counts)


def axis_counts(merged: DataFrame, limit: int | None = rules.MAX_FINDINGS_PER_AXIS) -> DataFrame:
    """Findings before the cap and dropped by it, per axis that has any."""
    limit = (1 << 62) if limit is None else limit
    return merged.groupBy(*KEY, "axis").agg(F.count("*").alias("found")).select(
        *KEY,
        "axis",
        "found",
        F.least("found", F.lit(limit).cast("long")).alias("kept"),
        F.greatest(F.col("found") - limit, F.lit(0).cast("long")).alias("dropped"),
    )


def axis_statuses(scopes: DataFrame, counts: DataFrame, axes: list[str] | None = None) -> DataFrame:
    """Every axis of every scope: ``issues_found`` if anything was found before the cap.

    ``scopes`` may carry ``unavailable`` (array of axis names) for axes that could not run.
    """
    axes = rules.AXES if axes is None else axes
    names = F.explode(F.array(*[F.lit(a) for a in axes])).alias("axis")
    closed = "unavailable" in scopes.columns
    all_axes = scopes.select(*KEY, names, *(["unavailable"] if closed else []))
    zero = F.lit(0).cast("long")
    status = F.when(F.coalesce("found", zero) > 0, F.lit("issues_found")).otherwise(F.lit("clean"))
    if closed:
        status = F.when(F.array_contains("unavailable", F.col("axis")), F.lit("unavailable")).otherwise(status)
    return all_axes.join(counts, [*KEY, "axis"], "left").select(
        *KEY,
        "axis",
        status.alias("status"),
        F.coalesce("kept", zero).alias("kept"),
        F.coalesce("dropped", zero).alias("dropped"),
    )


def axis_results(
    scopes: DataFrame,
    findings: DataFrame,
    limit: int = rules.MAX_FINDINGS_PER_AXIS,
    axes: list[str] | None = None,
) -> DataFrame:
    """Status, kept findings (an array bounded by ``limit``) and dropped count per axis."""
    merged = merge_findings(findings)
    statuses = axis_statuses(scopes, axis_counts(merged, limit), axes)
    kept = (
        rank_findings(merged, limit)
        .groupBy(*KEY, "axis")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", "id", *BODY, "locations", "occurrences")
                ),
                # maps do not compare, ranks do
                lambda a, b: a["rank"] - b["rank"],
            ).alias("findings")
        )
    )
    return statuses.join(kept, [*KEY, "axis"], "left").withColumn(
        "findings", F.coalesce("findings", F.array())
    )


def is_complete(truncated: Column, capped: Column, failures: Column) -> Column:
    """False for involuntary gaps only; deliberate exclusions do not count."""
    return ~(
        F.coalesce(truncated, F.lit(False))
        | (F.coalesce(capped, F.lit(0)) > 0)
        | (F.coalesce(failures, F.lit(0)) > 0)
    )


def downgrade_status(status: Column, complete: Column) -> Column:
    return F.when(
        (status == "clean") & ~F.coalesce(complete, F.lit(True)), F.lit("partial")
    ).otherwise(status)


def scan_summary(statuses: DataFrame, kept: DataFrame) -> DataFrame:
    """Totals per scan over kept findings, and the axes with issues in their fixed order."""
    in_order = F.filter(
        F.array(*[F.lit(a) for a in rules.AXES]),
        lambda axis: F.array_contains(F.col("with_issues"), axis),
    )
    totals = (
        statuses.groupBy(*KEY)
        .agg(
            F.sum("kept").alias("findings"),
            F.sum("dropped").alias("dropped"),
            F.collect_set(F.when(F.col("status") == "issues_found", F.col("axis"))).alias("with_issues"),
        )
        .withColumn("axes_with_issues", in_order)
        .drop("with_issues")
    )
    levels = severity_counts(kept)
    zero = F.lit(0).cast("long")
    return totals.join(levels, KEY, "left").select(
        *KEY,
        "findings",
        "dropped",
        *[F.coalesce(s, zero).alias(s) for s in rules.SEVERITIES],
        "axes_with_issues",
    )


def finding_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``added``, ``removed`` or ``unchanged`` for each id of either side."""
    old = before.select(*keys).distinct().withColumn("in_before", F.lit(True))
    new = after.select(*keys).distinct().withColumn("in_after", F.lit(True))
    change = (
        F.when(F.col("in_before").isNull(), F.lit("added"))
        .when(F.col("in_after").isNull(), F.lit("removed"))
        .otherwise(F.lit("unchanged"))
    )
    return old.join(new, keys, "full").select(*keys, change.alias("change"))


def legacy_issue(findings: DataFrame) -> DataFrame:
    """The stored issue shape: no ``info`` level, a shown path, evidence as ``code_hint``."""
    path = F.coalesce(F.when(F.col("file_path") != "", F.col("file_path")), F.lit("N/A"))
    return findings.withColumns(
        {
            "severity": T.legacy_severity("severity"),
            "file_path": path,
            "code_hint": F.col("evidence"),
        }
    ).drop("evidence", "line", "ord", "rank")


def split_by_verdict(issues: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Retained and dismissed lists, each by severity; unknown severities last.

    The order is a range-partitioned sort, so a list may be longer than one task can hold.
    """
    part = F.when(F.col("verdict") == rules.FALSE_POSITIVE, F.lit("dismissed")).otherwise(
        F.lit("retained")
    )
    return (
        issues.withColumn("list", part)
        .withColumn("severity_rank", T.severity_rank("severity"))
        .orderBy(*keys, "list", "severity_rank", *order)
    )
