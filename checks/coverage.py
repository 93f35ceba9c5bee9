"""File selection and its accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators import coverage as C
from assayer.plans import scan
from assayer.sources import tree as listing
from checks.corpus import FILES, NAME, SUFFIX, files, sql_list, tracked
from checks.paths import CI_PATH, TEST_PATH, sql_rejection
from checks.registry import query

K = ["repo", "commit_sha"]
CAP, MAX_SIZE = 8, 20_000
GUARDS = {"max_lines": 40, "minified_lines": 3, "minified_chars": 300}


def tree(spark, sf_dir):
    """A listing with directories, out of order, and one truncated repository."""
    return tracked(spark, sf_dir).select(
        *K, "ord", "path", "size",
        F.when(F.col("ord") % 9 == 0, F.lit("tree")).otherwise(F.lit("blob")).alias("type"),
        ((F.col("repo") == "src3") & (F.col("commit_sha") == "en")).alias("truncated"),
    )


def payloads(spark, sf_dir):
    """What a reader got per file: errors, missing and empty payloads among them."""
    n = F.col("ord")
    absent = (n % 19 == 0) | (n % 29 == 0) | (n % 23 == 0)
    return files(spark, sf_dir).select(
        *K, "path",
        F.when(n % 17 == 0, F.lit(404)).otherwise(F.lit(200)).alias("http_status"),
        F.when(n % 19 == 0, F.lit("none")).when(n % 29 == 0, F.lit("utf-16")).otherwise(F.lit("base64")).alias("encoding"),
        F.when(n % 23 == 0, F.lit(0)).otherwise(F.col("size")).alias("size"),
        F.when(absent, F.lit("")).otherwise(F.base64(F.encode("content", "UTF-8"))).alias("content_b64"),
    )


TREE = f"""tracked AS (SELECT *, {sql_rejection(MAX_SIZE)} AS reason FROM files WHERE ord % 9 <> 0)"""
OUTCOME = """CASE WHEN ord % 17 = 0 THEN 'fetch_http_error'
    WHEN ord % 19 = 0 THEN 'fetch_content_unavailable'
    WHEN ord % 23 = 0 AND ord % 29 = 0 THEN 'fetch_unexpected_payload'
    WHEN ord % 23 = 0 THEN 'empty_files'
    WHEN ord % 29 = 0 THEN 'fetch_unexpected_payload'
    WHEN len(string_split(content, chr(10))) > 40 THEN 'skipped_too_many_lines'
    WHEN len(string_split(content, chr(10))) <= 3 AND length(content) > 300 THEN 'skipped_minified' END"""
KEPT = f"""kept AS (SELECT *, {OUTCOME} AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha ORDER BY ord) AS place
    FROM tracked WHERE reason IS NULL) WHERE place <= {CAP})"""


@query(f"WITH {FILES}, {TREE} SELECT repo, commit_sha, ord, path FROM tracked")
def tracked_paths(spark, sf_dir):
    return listing.tracked_paths(tree(spark, sf_dir)).select(*K, "ord", "path")


@query(f"WITH {FILES}, {TREE}, {KEPT} SELECT ord, path FROM kept")
def capped_files(spark, sf_dir):
    rows = listing.tracked_paths(tree(spark, sf_dir))
    eligible = C.with_rejection(rows, MAX_SIZE).filter(F.col("reason").isNull())
    return C.cap_files(eligible, CAP).select("ord", "path")


@query(
    f"""WITH {FILES}, {TREE}, {KEPT} SELECT ord, outcome,
    CASE WHEN outcome = 'empty_files' THEN md5('') WHEN outcome IS NULL OR outcome LIKE 'skipped%' THEN md5(content) END AS digest FROM kept"""
)
def decoded_contents(spark, sf_dir):
    rows = listing.tracked_paths(tree(spark, sf_dir))
    eligible = C.with_rejection(rows, MAX_SIZE).filter(F.col("reason").isNull())
    kept = C.cap_files(eligible, CAP).select(*K, "ord", "path")
    read = listing.decode_contents(kept.join(payloads(spark, sf_dir), [*K, "path"]), **GUARDS)
    fetched = ~F.coalesce(F.col("outcome").isin(rules.FETCH_FAILURES), F.lit(False))
    return read.select("ord", "outcome", F.when(fetched, F.md5("content")).alias("digest"))


COVERAGE = f"""coverage AS (SELECT t.repo, t.commit_sha, t.tracked_files, t.excluded_by_path, t.excluded_by_extension, t.skipped_too_large,
    greatest(t.eligible - {CAP}, 0) AS capped_over_limit, coalesce(k.n, 0) AS eligible_files, coalesce(k.fetched, 0) AS fetched_files,
    coalesce(k.n, 0) - coalesce(k.fetched, 0) AS skipped, coalesce(k.too_many, 0) AS skipped_too_many_lines,
    coalesce(k.minified, 0) AS skipped_minified, coalesce(k.empty_files, 0) AS empty_files, coalesce(k.failures, 0) AS failures,
    t.repo = 'src3' AND t.commit_sha = 'en' AS tree_truncated
  FROM (SELECT repo, commit_sha, count(*) AS tracked_files, count(*) FILTER (WHERE reason IS NULL) AS eligible,
      count(*) FILTER (WHERE reason = 'excluded_by_path') AS excluded_by_path,
      count(*) FILTER (WHERE reason = 'excluded_by_extension') AS excluded_by_extension,
      count(*) FILTER (WHERE reason = 'skipped_too_large') AS skipped_too_large FROM tracked GROUP BY ALL) t
  LEFT JOIN (SELECT repo, commit_sha, count(*) AS n, count(*) FILTER (WHERE outcome IS NULL OR outcome = 'empty_files') AS fetched,
      count(*) FILTER (WHERE outcome = 'skipped_too_many_lines') AS too_many, count(*) FILTER (WHERE outcome = 'skipped_minified') AS minified,
      count(*) FILTER (WHERE outcome = 'empty_files') AS empty_files, count(*) FILTER (WHERE outcome LIKE 'fetch_%') AS failures
    FROM kept GROUP BY ALL) k ON t.repo = k.repo AND t.commit_sha = k.commit_sha)"""


def prepared(spark, sf_dir):
    return scan.prepare_files(
        tree(spark, sf_dir), payloads(spark, sf_dir), max_files=CAP, max_size=MAX_SIZE, **GUARDS
    )


def flat_coverage(cov):
    def count(column, key):
        return F.coalesce(F.try_element_at(column, F.lit(key)), F.lit(0).cast("long")).alias(key)

    return cov.select(
        *K, "tracked_files", "eligible_files", "fetched_files", "skipped", "capped_over_limit", "tree_truncated",
        *[
            count("excluded", key)
            for key in (
                "excluded_by_path", "excluded_by_extension", "skipped_too_large",
                "skipped_too_many_lines", "skipped_minified",
            )
        ],
        count("fetched_detail", "empty_files"),
        C.sum_values(F.col("fetch_failures")).alias("failures"),
    )


@query(f"WITH {FILES}, {TREE}, {KEPT}, {COVERAGE} SELECT * FROM coverage")
def scan_coverage(spark, sf_dir):
    return flat_coverage(prepared(spark, sf_dir).coverage)


@query(
    f"""WITH {FILES}, {TREE}, {KEPT}, {COVERAGE} SELECT repo, commit_sha, NOT (tree_truncated OR capped_over_limit > 0 OR failures > 0) AS complete,
    concat_ws(',', CASE WHEN capped_over_limit > 0 THEN concat('capped:', capped_over_limit) END,
      CASE WHEN tree_truncated THEN 'truncated' END, CASE WHEN failures > 0 THEN concat('failures:', failures) END) AS gaps FROM coverage"""
)
def coverage_gaps(spark, sf_dir):
    gaps = C.coverage_gaps(prepared(spark, sf_dir).coverage)
    shown = F.transform("gaps", lambda g: F.concat_ws(":", g["key"], g["count"].cast("string")))
    return gaps.select(*K, "complete", F.array_join(shown, ",").alias("gaps"))


@query(f"WITH {FILES}, {TREE}, {KEPT} SELECT repo, commit_sha, ord, path, {SUFFIX} <> '' AS has_suffix FROM kept WHERE outcome IS NULL OR outcome = 'empty_files'")
def prepare_files(spark, sf_dir):
    kept = prepared(spark, sf_dir).files
    return kept.select(*K, "ord", "path", (F.col("language") != "text").alias("has_suffix"))


@query(
    f"""WITH {FILES} SELECT repo, commit_sha, bool_or({SUFFIX} IN {sql_list(rules.ALL_SOURCE_EXTENSIONS)}) AS has_sources,
    bool_or({TEST_PATH}) AS has_tests, bool_or({CI_PATH}) AS has_ci, coalesce(string_agg(path, ',' ORDER BY ord) FILTER (WHERE {CI_PATH}), '') AS ci_files
    FROM files GROUP BY repo, commit_sha"""
)
def repo_flags(spark, sf_dir):
    rows = tracked(spark, sf_dir)
    return C.repo_flags(rows).join(C.ci_files(rows), K, "left").select(
        *K, "has_sources", "has_tests", "has_ci",
        F.coalesce(F.array_join("ci_files", ","), F.lit("")).alias("ci_files"),
    )


@query(
    f"""WITH {FILES}, counted AS (SELECT repo, commit_sha, count(*) FILTER (WHERE s) AS source_files_in_sample, count(*) FILTER (WHERE s AND t) AS test_files_in_sample
      FROM (SELECT *, {SUFFIX} IN {sql_list(rules.ALL_SOURCE_EXTENSIONS)} AS s, {TEST_PATH} AS t FROM files) GROUP BY repo, commit_sha)
    SELECT *, round_even(test_files_in_sample / nullif(source_files_in_sample - test_files_in_sample, 0), 2) AS test_ratio_in_sample FROM counted"""
)
def sample_counts(spark, sf_dir):
    return C.sample_counts(files(spark, sf_dir))


@query(
    f"""WITH {FILES} SELECT repo, commit_sha, arg_min(path, ord) AS first_readme, arg_max(path, ord) AS last_readme
    FROM files WHERE lower({NAME}) = 'readme.md' GROUP BY repo, commit_sha"""
)
def readme_choice(spark, sf_dir):
    rows = tracked(spark, sf_dir)
    first = C.pick_readme(rows).withColumnRenamed("path", "first_readme")
    last = C.pick_readme(rows, first=False).withColumnRenamed("path", "last_readme")
    return first.join(last, K)


@query(f"WITH {FILES} SELECT ord, CASE WHEN lower({NAME}) = 'readme.md' THEN 'readme' ELSE 'code' END AS file_type FROM files")
def readme_split(spark, sf_dir):
    from assayer.operators.chunks import split_readme

    return split_readme(tracked(spark, sf_dir)).select("ord", "file_type")
