"""Documentation against the repository: links and environment variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.operators import KEY
from assayer.operators.findings import make_findings

AXIS = "readme_check"


def extract_links(hits: DataFrame) -> DataFrame:
    """One row per Markdown link: ``(…, path, line_no, link_pos, target)``."""
    return hits.select(
        *KEY, "ord", "path", "line_no", F.posexplode("links").alias("link_pos", "target")
    )


def broken_links(links: DataFrame, tracked: DataFrame) -> DataFrame:
    """Links whose resolved, checkable target is not a tracked path."""
    resolved = links.withColumn("resolved", P.resolve_link("path", "target")).filter(
        F.col("resolved").isNotNull() & P.is_checkable("resolved")
    )
    known = tracked.select(*KEY, F.col("path").alias("resolved"))
    return resolved.join(known, [*KEY, "resolved"], "left_anti")


def env_usage(hits: DataFrame) -> DataFrame:
    """One row per read of an environment variable."""
    return hits.select(
        *KEY, "ord", "path", "line_no", F.explode("env_reads").alias("read")
    ).select(*KEY, "ord", "path", "line_no", "read.*")


def first_usage(usage: DataFrame) -> DataFrame:
    """Where each variable is read first, in file, line and pattern order."""
    order = F.struct("ord", "line_no", "pattern", "pos")
    return usage.groupBy(*KEY, "name").agg(
        F.min_by(F.struct("path", "line_no"), order).alias("at")
    ).select(*KEY, "name", F.col("at.path").alias("path"), F.col("at.line_no").alias("line_no"))


def env_declared(hits: DataFrame) -> DataFrame:
    return (
        hits.filter(F.col("declared").isNotNull())
        .select(*KEY, F.col("declared").alias("name"))
        .distinct()
    )


def doc_mentions(hits: DataFrame) -> DataFrame:
    return hits.select(*KEY, F.explode("tokens").alias("name")).distinct()


def _not_platform(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("name").isin(rules.PLATFORM_ENV))


def undocumented_env(used: DataFrame, declared: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Variables read by code and named neither in a template nor in a document."""
    known = declared.select(*KEY, "name").union(mentioned.select(*KEY, "name"))
    return _not_platform(used).join(known, [*KEY, "name"], "left_anti")


def unused_env(declared: DataFrame, used: DataFrame) -> DataFrame:
    return _not_platform(declared).join(used.select(*KEY, "name"), [*KEY, "name"], "left_anti")


def missing_env_template(used: DataFrame, flags: DataFrame) -> DataFrame:
    """Repositories that read several variables and offer no template file."""
    counts = used.groupBy(*KEY).agg(F.count("*").alias("env_used"))
    return counts.filter(F.col("env_used") >= rules.MIN_ENV_VARS_FOR_EXAMPLE).join(
        flags.filter(F.col("has_env_example")).select(*KEY), KEY, "left_anti"
    )


def doc_metrics(
    files: DataFrame, flags: DataFrame, used: DataFrame, declared: DataFrame
) -> DataFrame:
    """Per scan: documents, variables used and declared; unavailable without documents."""
    documents = files.groupBy(*KEY).agg(F.count_if(P.is_markdown("path")).alias("documents"))
    used_n = used.groupBy(*KEY).agg(F.count("*").alias("env_used"))
    declared_n = declared.groupBy(*KEY).agg(F.count("*").alias("env_declared"))
    zero = F.lit(0).cast("long")
    joined = (
        flags.select(*KEY, "has_env_example")
        .join(documents, KEY, "left")
        .join(used_n, KEY, "left")
        .join(declared_n, KEY, "left")
    )
    documented = F.coalesce("documents", zero)
    return joined.select(
        *KEY,
        documented.alias("documents"),
        F.coalesce("env_used", zero).alias("env_used"),
        F.coalesce("env_declared", zero).alias("env_declared"),
        "has_env_example",
        (documented > 0).alias("available"),
    )


# --- findings -----------------------------------------------------------------------------


def link_findings(broken: DataFrame) -> DataFrame:
    return make_findings(
        broken,
        axis=AXIS,
        rule=F.lit("docs.broken_link"),
        severity=F.lit("medium"),
        source="links",
        source_ord=0,
        file_path=F.col("path"),
        line=F.col("line_no"),
        evidence=F.col("target"),
        identity=F.col("resolved"),
        params={
            "target": F.col("target"),
            "resolved": F.col("resolved"),
            "line": F.col("line_no"),
        },
        file_ord=F.col("ord"),
        item=F.col("link_pos"),
    )


def env_findings(undocumented: DataFrame, unused: DataFrame, no_template: DataFrame) -> list[DataFrame]:
    name = F.col("name")
    return [
        make_findings(
            undocumented,
            axis=AXIS,
            rule=F.lit("docs.undocumented_env"),
            severity=F.lit("medium"),
            source="env",
            source_ord=1,
            file_path=F.col("path"),
            line=F.col("line_no"),
            evidence=name,
            identity=name,
            params={"name": name, "line": F.col("line_no")},
            line_ord=F.lit(0),
            order_text=name,
        ),
        make_findings(
            unused,
            axis=AXIS,
            rule=F.lit("docs.unused_env"),
            severity=F.lit("low"),
            source="env",
            source_ord=2,
            evidence=name,
            identity=name,
            params={"name": name},
            order_text=name,
        ),
        make_findings(
            no_template,
            axis=AXIS,
            rule=F.lit("docs.no_env_example"),
            severity=F.lit("medium"),
            source="env",
            source_ord=3,
            params={"count": F.col("env_used")},
        ),
    ]
