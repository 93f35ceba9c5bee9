"""Path predicates and path-derived columns, one row per file."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators import quality
from checks.corpus import FILES, NAME, SUFFIX, files, sql_list, sql_strip, tracked
from checks.registry import query

PARENTS = "string_split(path, '/')[1:len(string_split(path, '/')) - 1]"
ALLOWED = f"({NAME} IN {sql_list(rules.ALLOWED_FILENAMES)} OR {SUFFIX} IN {sql_list(rules.ALLOWED_EXTENSIONS)})"


def sql_array(values: list[str]) -> str:
    return "[" + sql_list(values)[1:-1] + "]"


def sql_rejection(max_size: int) -> str:
    return f"""CASE WHEN list_has_any({PARENTS}, {sql_array(rules.EXCLUDED_DIRS)}) THEN 'excluded_by_path'
      WHEN size > {max_size} THEN 'skipped_too_large' WHEN {ALLOWED} THEN NULL ELSE 'excluded_by_extension' END"""


def sql_map(mapping: dict[str, str], key: str) -> str:
    branches = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {key} {branches} END"


SENSITIVE = f"""CASE WHEN {NAME} NOT IN {sql_list(rules.ENV_TEMPLATE_NAMES)}
  THEN coalesce({sql_map(rules.SENSITIVE_NAMES, NAME)}, {sql_map(rules.SENSITIVE_SUFFIXES, SUFFIX)}) END"""
TEST_PATH = f"""(list_has_any({PARENTS}, {sql_array(rules.TEST_DIR_NAMES)})
  OR regexp_matches(path, '(?i){rules.TEST_FILE_PATTERN}'))"""
CI_PATH = f"regexp_matches(path, '{rules.CI_FILE_PATTERN}')"


@query(f"WITH {FILES} SELECT ord, path, {sql_rejection(20_000)} AS reason FROM files")
def rejection_reason(spark, sf_dir):
    reason = P.rejection_reason("path", "size", 20_000)
    return tracked(spark, sf_dir).select("ord", "path", reason.alias("reason"))


@query(
    rf"""WITH {FILES} SELECT ord, {NAME} AS name,
    regexp_extract({NAME}, '^.+([.][^.]+)$', 1) AS suffix,
    CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent FROM files"""
)
def path_parts(spark, sf_dir):
    return tracked(spark, sf_dir).select(
        "ord",
        P.path_name("path").alias("name"),
        P.path_suffix("path").alias("suffix"),
        P.path_parent("path").alias("parent"),
    )


@query(
    rf"""WITH {FILES} SELECT ord, coalesce(nullif(substr(regexp_extract({NAME}, '^.+([.][^.]+)$', 1), 2), ''), 'text')
    AS language FROM files"""
)
def file_language(spark, sf_dir):
    return tracked(spark, sf_dir).select("ord", P.file_language("path").alias("language"))


@query(f"WITH {FILES} SELECT ord, {TEST_PATH} AS is_test FROM files")
def test_paths(spark, sf_dir):
    return tracked(spark, sf_dir).select("ord", P.is_test_path("path").alias("is_test"))


@query(f"WITH {FILES} SELECT ord, {CI_PATH} AS is_ci FROM files")
def ci_paths(spark, sf_dir):
    return tracked(spark, sf_dir).select("ord", P.is_ci_path("path").alias("is_ci"))


@query(f"WITH {FILES} SELECT ord, {SENSITIVE} AS kind FROM files")
def sensitive_names(spark, sf_dir):
    return tracked(spark, sf_dir).select("ord", P.classify_sensitive("path").alias("kind"))


@query(f"WITH {FILES} SELECT ord, {SUFFIX} IN {sql_list(rules.ALL_SOURCE_EXTENSIONS)} AS is_source FROM files")
def source_files(spark, sf_dir):
    return tracked(spark, sf_dir).select("ord", P.is_source("path").alias("is_source"))


@query(f"WITH {FILES} SELECT ord, {ALLOWED} AS checkable FROM files")
def checkable_targets(spark, sf_dir):
    return tracked(spark, sf_dir).select("ord", P.is_checkable("path").alias("checkable"))


@query(
    f"""WITH {FILES} SELECT ord, path FROM files WHERE {SUFFIX} IN {sql_list(rules.RUFF_EXTENSIONS + rules.ESLINT_EXTENSIONS)}
    AND {sql_strip('content')} <> ''"""
)
def lintable_files(spark, sf_dir):
    extensions = rules.RUFF_EXTENSIONS + rules.ESLINT_EXTENSIONS
    return quality.lintable(files(spark, sf_dir), extensions).select("ord", "path")


@query(
    f"""WITH {FILES} SELECT ord,
    CASE WHEN lower({NAME}) = 'readme.md' THEN 1000 WHEN {SUFFIX} IN {sql_list(rules.CONFIG_EXTENSIONS)} THEN 800
      WHEN {SUFFIX} IN {sql_list(rules.DOC_EXTENSIONS)} THEN 1000 ELSE 1500 END AS chunk_size,
    CASE WHEN lower({NAME}) = 'readme.md' THEN 300 WHEN {SUFFIX} IN {sql_list(rules.CONFIG_EXTENSIONS)} THEN 100
      WHEN {SUFFIX} IN {sql_list(rules.DOC_EXTENSIONS)} THEN 300 ELSE 200 END AS chunk_overlap FROM files"""
)
def chunk_params(spark, sf_dir):
    params = P.chunk_params("path")
    return tracked(spark, sf_dir).select(
        "ord",
        params["chunk_size"].alias("chunk_size"),
        params["chunk_overlap"].alias("chunk_overlap"),
    )


@query(
    f"""WITH {FILES} SELECT ord, substr(concat('cc-', substr(sha, 1, 8), '-',
    lower(translate(concat('Owner_X/', repo, '_', path), '/_', '--')), '-', substr(sha, 9, 8)), 1, 63) AS collection FROM files"""
)
def collection_names(spark, sf_dir):
    repo = F.concat(F.lit("Owner_X/"), "repo", F.lit("_"), "path")
    name = P.collection_name(F.col("sha"), repo, F.substring("sha", 9, 32))
    return files(spark, sf_dir).select("ord", name.alias("collection"))


@query(
    f"""WITH {FILES} SELECT ord, len(string_split(concat(repo, '/', path), '/')) = 2 AS valid,
    concat('report_', replace(path, '/', '_'), '_', strftime(TIMESTAMP '2024-03-01 10:00:00' + to_days(CAST(ord % 400 AS INT)), '%Y%m%d'), '.json') AS export_name FROM files"""
)
def repo_and_export_names(spark, sf_dir):
    created = F.expr("timestamp_ntz'2024-03-01 10:00:00' + make_dt_interval(CAST(ord % 400 AS INT))")
    return tracked(spark, sf_dir).select(
        "ord",
        T.valid_repo_name(F.concat_ws("/", "repo", "path")).alias("valid"),
        T.export_name(F.col("path"), created, "json").alias("export_name"),
    )
