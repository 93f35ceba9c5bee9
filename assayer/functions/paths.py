"""Scalar path functions (POSIX paths, no regard to any local file system)."""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable
from itertools import chain

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions.text import _col, strip


def reused(fn: Callable[..., Column]) -> Callable[..., Column]:
    """Build the expression for a column name once per application.

    The long constant lists cost a call into the JVM per entry, each time an expression is
    written; expressions are immutable and refer to columns by name, so they can be shared.
    """
    built: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

    @functools.wraps(fn)
    def call(path: Column | str, *args: object) -> Column:
        if not isinstance(path, str) or any(isinstance(a, Column) for a in args):
            return fn(path, *args)
        known = built.setdefault(SparkContext.getOrCreate(), {})
        key = (path, *args)
        if key not in known:
            known[key] = fn(path, *args)
        return known[key]

    return call


@reused
def path_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


@reused
def path_suffix(path: Column | str) -> Column:
    """Last dotted part of the name; a leading dot alone (``.env``) is no suffix."""
    return F.regexp_extract(_col(path), r"^(?:.*/)?[^/]+(\.[^./]+)$", 1)


@reused
def path_parent(path: Column | str) -> Column:
    """Directory of a path, ``.`` at the root."""
    parent = F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.lit(".")).otherwise(parent)


@reused
def parent_dirs(path: Column | str) -> Column:
    parts = F.split(_col(path), "/", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


@reused
def lower_suffix(path: Column | str) -> Column:
    return F.lower(path_suffix(path))


@reused
def file_language(path: Column | str) -> Column:
    suffix = path_suffix(path)
    return F.when(suffix == "", F.lit("text")).otherwise(F.substring(suffix, 2, 1_000_000))


def _literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])


@reused
def rejection_reason(
    path: Column | str, size: Column | str, max_size: int = rules.MAX_FILE_SIZE
) -> Column:
    """Why a tracked file is not read, first reason wins; null when it is eligible."""
    return (
        F.when(
            F.arrays_overlap(parent_dirs(path), _literal_array(rules.EXCLUDED_DIRS)),
            F.lit(rules.EXCLUDED_BY_PATH),
        )
        .when(F.coalesce(_col(size), F.lit(0)) > max_size, F.lit(rules.SKIPPED_TOO_LARGE))
        .when(is_checkable(path), F.lit(None).cast("string"))
        .otherwise(F.lit(rules.EXCLUDED_BY_EXTENSION))
    )


@reused
def is_checkable(path: Column | str) -> Column:
    """The name or the lower-cased suffix is on the allowed lists."""
    return path_name(path).isin(rules.ALLOWED_FILENAMES) | lower_suffix(path).isin(
        rules.ALLOWED_EXTENSIONS
    )


@reused
def is_test_path(path: Column | str) -> Column:
    return F.arrays_overlap(parent_dirs(path), _literal_array(rules.TEST_DIR_NAMES)) | _col(
        path
    ).rlike("(?iu)" + rules.TEST_FILE_PATTERN)


@reused
def is_ci_path(path: Column | str) -> Column:
    return _col(path).rlike(rules.CI_FILE_PATTERN)


@reused
def is_env_template(path: Column | str) -> Column:
    return path_name(path).isin(rules.ENV_TEMPLATE_NAMES)


@reused
def classify_sensitive(path: Column | str) -> Column:
    """Rule name for files that should never be committed, else null."""
    by_name = F.try_element_at(literal_map(rules.SENSITIVE_NAMES), path_name(path))
    by_suffix = F.try_element_at(literal_map(rules.SENSITIVE_SUFFIXES), lower_suffix(path))
    return F.when(~is_env_template(path), F.coalesce(by_name, by_suffix))


@reused
def is_source(path: Column | str) -> Column:
    return lower_suffix(path).isin(rules.ALL_SOURCE_EXTENSIONS)


@reused
def is_markdown(path: Column | str) -> Column:
    return lower_suffix(path).isin(rules.MARKDOWN_EXTENSIONS)


@reused
def is_readme(path: Column | str) -> Column:
    return F.lower(path_name(path)) == rules.README_NAME


@reused
def chunk_kind(path: Column | str) -> Column:
    suffix = lower_suffix(path)
    return (
        F.when(is_readme(path), F.lit("docs"))
        .when(suffix.isin(rules.CONFIG_EXTENSIONS), F.lit("config"))
        .when(suffix.isin(rules.DOC_EXTENSIONS), F.lit("docs"))
        .otherwise(F.lit("code"))
    )


@reused
def chunk_params(path: Column | str) -> Column:
    """``struct(chunk_size, chunk_overlap)`` for a file."""
    kind = chunk_kind(path)

    def pick(index: int) -> Column:
        sizes = {name: values[index] for name, values in rules.CHUNK_SIZES.items()}
        return (
            F.when(kind == "config", F.lit(sizes["config"]))
            .when(kind == "docs", F.lit(sizes["docs"]))
            .otherwise(F.lit(sizes["code"]))
        )

    return F.struct(pick(0).alias("chunk_size"), pick(1).alias("chunk_overlap"))


def normalize_parts(parts: Column) -> Column:
    """Fold ``.`` and ``..``; climbing above the root leaves a leading ``..``."""
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when((part == "") | (part == "."), done)
        .when(
            (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .otherwise(F.concat(done, F.array(part))),
    )


def resolve_link(document: Column | str, target: Column | str) -> Column:
    """Repository path a link points at; null for external, empty or escaping targets."""
    bare = F.split_part(F.split_part(_col(target), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    cleaned = strip(bare)
    external = F.lit(False)
    for prefix in rules.EXTERNAL_PREFIXES:
        external = external | F.startswith(F.lower(cleaned), F.lit(prefix))
    joined = F.when(F.startswith(cleaned, F.lit("/")), cleaned).otherwise(
        F.concat_ws("/", F.array_join(parent_dirs(document), "/"), cleaned)
    )
    resolved = F.array_join(normalize_parts(F.split(joined, "/", -1)), "/")
    usable = (
        (cleaned != "") & ~external & (resolved != "") & ~F.startswith(resolved, F.lit(".."))
    )
    return F.when(usable, resolved)


def collection_key(user_id: Column, repo: Column, sha: Column) -> Column:
    """What tells collections apart in an index: a digest over the whole user, name and commit."""
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in (user_id, repo, sha)]
    return F.concat(F.lit(rules.COLLECTION_PREFIX + "-"), F.sha1(F.concat_ws("\n", *parts)))


def collection_name(user_id: Column, repo: Column, sha: Column) -> Column:
    """A short label for people; long or look-alike names can share one, so nothing is keyed by it."""
    cleaned = F.lower(F.translate(repo, "/_", "--"))
    name = F.concat_ws(
        "-",
        F.lit(rules.COLLECTION_PREFIX),
        F.substring(user_id, 1, 8),
        cleaned,
        F.substring(sha, 1, 8),
    )
    return F.substring(name, 1, rules.MAX_COLLECTION_NAME)
