"""Which tracked files are read, and an account of every file that is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators import KEY
from assayer.operators.findings import is_complete
from assayer.session import small_side


def with_rejection(tracked: DataFrame, max_size: int = rules.MAX_FILE_SIZE) -> DataFrame:
    return tracked.withColumn("reason", P.rejection_reason("path", "size", max_size))


def cap_cutoffs(eligible: DataFrame, limit: int = rules.MAX_REPO_FILES) -> DataFrame:
    """``(repo, commit_sha, cutoff)`` for repositories with more than ``limit`` files.

    The row-number filter is a group limit below the shuffle, so each task contributes at most
    ``limit`` + 1 orders per repository; repositories under the cap do not appear at all.
    """
    order = Window.partitionBy(*KEY).orderBy("ord")
    first = (
        eligible.select(*KEY, "ord")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit + 1)
    )
    return (
        first.groupBy(*KEY)
        .agg(
            F.count("*").alias("seen"),
            F.max(F.when(F.col("place") == limit, F.col("ord"))).alias("cutoff"),
        )
        .filter(F.col("seen") > limit)
        .select(*KEY, "cutoff")
    )


def cap_files(
    files: DataFrame, limit: int = rules.MAX_REPO_FILES, eligible: DataFrame | None = None
) -> DataFrame:
    """The first ``limit`` eligible files of each repository in tree order.

    Contents are never ranked or sorted: only the orders are, from ``eligible`` (metadata with
    the same orders, by default ``files`` itself), and the wide rows meet a cutoff that exists
    for over-full repositories only.  That side is broadcast when counted to be small, so the
    wide rows stay where they were read; otherwise hot partitions of the join are split.
    """
    cutoffs = small_side(cap_cutoffs(files if eligible is None else eligible, limit))
    return (
        files.join(cutoffs, KEY, "left")
        .filter(F.col("cutoff").isNull() | (F.col("ord") <= F.col("cutoff")))
        .drop("cutoff")
    )


def file_counts(
    tracked: DataFrame,
    contents: DataFrame,
    limit: int = rules.MAX_REPO_FILES,
    max_size: int = rules.MAX_FILE_SIZE,
) -> DataFrame:
    """``(repo, commit_sha, outcome, n)``: each tracked file counted under one outcome.

    ``contents`` holds the read attempts of the kept files with their ``outcome`` (null when
    read).  Outcome ``fetched`` is the rest; ``empty_files`` is a note on fetched files and is
    reported besides it.
    """
    rejected = (
        with_rejection(tracked, max_size)
        .groupBy(*KEY, F.col("reason").alias("outcome"))
        .agg(F.count("*").alias("n"))
    )
    eligible = F.col("outcome").isNull()
    over = (
        rejected.filter(eligible & (F.col("n") > limit))
        .select(*KEY, F.lit(rules.CAPPED_OVER_LIMIT).alias("outcome"), (F.col("n") - limit).alias("n"))
    )
    read = F.coalesce(F.col("outcome"), F.lit("fetched"))
    attempts = contents.groupBy(*KEY, read.alias("outcome")).agg(F.count("*").alias("n"))
    return rejected.filter(~eligible).unionByName(over).unionByName(attempts)


def coverage(counts: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """One row per scan: totals and the maps of exclusions, failures and notes.

    ``tracked_files`` = fetched + excluded + failures.  Skips on purpose (too many lines,
    minified) are exclusions, not failures; an empty file is fetched and noted.
    """
    outcome, n = F.col("outcome"), F.col("n")
    fetched = outcome.isin("fetched", rules.EMPTY_FILES)
    failed = outcome.isin(rules.FETCH_FAILURES)
    zero = F.lit(0).cast("long")

    def tally(condition: Column) -> Column:
        entries = F.collect_list(F.when(condition, F.struct(outcome.alias("key"), n.alias("value"))))
        return F.map_from_entries(F.array_sort(entries))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), zero)

    not_eligible = outcome.isin(
        rules.EXCLUDED_BY_PATH,
        rules.EXCLUDED_BY_EXTENSION,
        rules.SKIPPED_TOO_LARGE,
        rules.CAPPED_OVER_LIMIT,
    )
    result = counts.groupBy(*KEY).agg(
        total(F.lit(True)).alias("tracked_files"),
        total(~not_eligible).alias("eligible_files"),
        total(fetched).alias("fetched_files"),
        tally(~fetched & ~failed).alias("excluded"),
        tally(failed).alias("fetch_failures"),
        tally(outcome == rules.EMPTY_FILES).alias("fetched_detail"),
        total(outcome == rules.CAPPED_OVER_LIMIT).alias("capped_over_limit"),
    )
    result = result.withColumn("skipped", F.col("eligible_files") - F.col("fetched_files"))
    if truncated is None:
        return result.withColumn("tree_truncated", F.lit(False))
    flags = truncated.groupBy(*KEY).agg(F.bool_or("truncated").alias("tree_truncated"))
    return result.join(flags, KEY, "left").withColumn(
        "tree_truncated", F.coalesce("tree_truncated", F.lit(False))
    )


def sum_values(counts: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.aggregate(F.coalesce(F.map_values(counts), F.array(zero)), zero, lambda a, v: a + v)


def complete(cov: DataFrame) -> DataFrame:
    flag = is_complete(
        F.col("tree_truncated"), F.col("capped_over_limit"), sum_values(F.col("fetch_failures"))
    )
    return cov.withColumn("complete", flag)


def coverage_gaps(cov: DataFrame) -> DataFrame:
    """Gaps to show for an incomplete scan: ``array<struct<key, count>>``, else empty."""
    failures = sum_values(F.col("fetch_failures"))

    def gap(condition: Column, key: str, count: Column) -> Column:
        return F.when(
            condition, F.struct(F.lit(key).alias("key"), count.cast("long").alias("count"))
        )

    gaps = F.array(
        gap(F.col("capped_over_limit") > 0, "capped", F.col("capped_over_limit")),
        gap(F.col("tree_truncated"), "truncated", F.lit(None)),
        gap(failures > 0, "failures", failures),
    )
    return complete(cov).withColumn("gaps", F.filter(gaps, lambda g: g.isNotNull()))


def repo_flags(tracked: DataFrame) -> DataFrame:
    """Existence facts over all tracked paths, not only over the files that were read."""
    return tracked.groupBy(*KEY).agg(
        F.bool_or(P.is_source("path")).alias("has_sources"),
        F.bool_or(P.is_test_path("path")).alias("has_tests"),
        F.bool_or(P.is_ci_path("path")).alias("has_ci"),
        F.count_if(P.is_ci_path("path")).alias("ci_count"),
        F.bool_or(P.is_env_template("path")).alias("has_env_example"),
    )


def ci_files(tracked: DataFrame) -> DataFrame:
    """Pipeline files of a repository in tree order."""
    return (
        tracked.filter(P.is_ci_path("path"))
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("found"))
        .select(*KEY, F.col("found.path").alias("ci_files"))
    )


def sample_counts(files: DataFrame) -> DataFrame:
    """Counts over the files that were read; the ratio is null without production files."""
    source, test = P.is_source("path"), P.is_test_path("path")
    counted = files.groupBy(*KEY).agg(
        F.count_if(source).alias("source_files_in_sample"),
        F.count_if(source & test).alias("test_files_in_sample"),
    )
    production = F.col("source_files_in_sample") - F.col("test_files_in_sample")
    ratio = F.col("test_files_in_sample") / F.nullif(production, F.lit(0))
    return counted.withColumn("test_ratio_in_sample", T.round_to(ratio, 2))


def pick_readme(files: DataFrame, first: bool = True) -> DataFrame:
    """The README of each repository: the reader takes the first one, the chunker the last."""
    pick = F.min_by if first else F.max_by
    return files.filter(P.is_readme("path")).groupBy(*KEY).agg(pick("path", "ord").alias("path"))
