"""Ignore files against tracked paths.

A rule file at ``base`` applies below ``base``.  Paths are exploded to their ancestor
directories, so finding the rule files that apply is an equi-join on ``(repo, commit, base)``
instead of a prefix test.  The rules of one file stay one array (a file bounds them), so "last
matching rule wins" is decided inside a row, without another shuffle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators import KEY
from assayer.operators.findings import make_findings
from assayer.operators.lines import ignore_rule_text
from assayer.session import materialize

AXIS = "gitignore_check"
COMPILED = ArrayType(
    StructType([StructField("regex", StringType()), StructField("negated", BooleanType())])
)

TOKENS = re.compile(
    r"(?P<deep>(?<![^/])\*\*/)"  # "**/": any number of directories
    r"|(?P<rest>(?<=/)\*\*$)"  # "/**" at the end: everything below
    r"|(?P<star>\*+)"
    r"|(?P<one>\?)"
    r"|(?P<escaped>\\.)"
    r"|\[(?P<not>[!^]?)(?P<set>\]?[^\]/]*)\]"
    r"|(?P<char>.)",
    re.DOTALL,
)


def _char(c: str) -> str:
    """One character, whatever it means in an expression."""
    return f"\\U{ord(c):08x}"


def _character_class(negated: bool, members: str) -> str:
    """A bracket expression."""
    members = re.sub(r"\\(.)", r"\1", members)
    out, i = [], 0
    while i < len(members):
        if i + 2 < len(members) and members[i + 1] == "-":
            low, high = members[i], members[i + 2]
            if low <= high:
                out.append(f"{_char(low)}-{_char(high)}")
            i += 3
        else:
            out.append(_char(members[i]))
            i += 1
    if not out:
        return "[^/]" if negated else "(?!)"
    return f"(?!/)[{'^' if negated else ''}{''.join(out)}]"


def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """``(regex, negated)`` for one ignore rule, or None for a blank or a comment.

    The regex matches a path relative to the rule file; directories end in ``/``.  What lies
    below an ignored directory is found through the directory, not through the regex.
    """
    if rule.startswith("#"):
        return None
    text = re.sub(r"(?<!\\)[ \t]+$", "", rule)
    negated = text.startswith("!")
    text = text[1:] if negated else text
    only_dirs = text.endswith("/")
    text = text.rstrip("/") if only_dirs else text
    if not text.strip("/"):
        return None
    anchored = "/" in text
    text = text.removeprefix("/")

    out = ["" if anchored else "(?:.*/)?"]
    for token in TOKENS.finditer(text):
        kind, found = token.lastgroup, token.group()
        if kind == "deep":
            out.append("(?:.*/)?")
        elif kind == "rest":
            out.append("(?=[^/]).+")
        elif kind == "star":
            # a part of a path is never empty: ``dir/*`` is not ``dir/`` itself
            begins = token.start() == 0 or text[token.start() - 1] == "/"
            out.append("(?=[^/])[^/]*" if begins else "[^/]*")
        elif kind == "one":
            out.append("[^/]")
        elif kind == "escaped":
            out.append(_char(found[1]))
        elif token["set"] is not None:
            out.append(_character_class(bool(token["not"]), token["set"]))
        elif re.match(r"[A-Za-z0-9_/]", found, re.ASCII):
            out.append(found)
        else:
            out.append(_char(found))
    return f"(?s:{''.join(out)}{'/' if only_dirs else '/?'})", negated


@F.pandas_udf(COMPILED)
def compile_rules(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Rule lines of one file to ordered regexes; the text is translated, nothing is matched."""
    for batch in batches:
        compiled = []
        for lines in batch:
            translated = [ignore_regex(line) for line in lines]
            compiled.append([{"regex": t[0], "negated": t[1]} for t in translated if t])
        yield pd.Series(compiled)


def ignore_specs(files: DataFrame) -> DataFrame:
    """One row per ignore file: ``(…, base, rules, rule_count)``."""
    parent = P.path_parent("path")
    base = F.when(parent == ".", F.lit("")).otherwise(F.concat(parent, F.lit("/")))
    lines = T.drop_last(T.split_lines("content"))
    counted = F.size(F.filter(lines, lambda line: ignore_rule_text(line).isNotNull()))
    return files.filter(P.path_name("path") == rules.IGNORE_FILE).select(
        *KEY, base.alias("base"), compile_rules(lines).alias("rules"), counted.alias("rule_count")
    )


def base_dirs(path: Column) -> Column:
    """``''`` and every ancestor directory with a trailing slash."""
    parts = P.parent_dirs(path)
    below = F.transform(
        parts, lambda _, i: F.concat(F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/"))
    )
    return F.concat(F.array(F.lit("")), below)


@functools.lru_cache(maxsize=1 << 14)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex)


class _Rules:
    """The rules of one file, patterns compiled once."""

    def __init__(self, spec: tuple[tuple[str, bool], ...]) -> None:
        self.last_first = [(_compiled(regex), negated) for regex, negated in reversed(spec)]

    def matched(self, candidate: str) -> bool:
        """Does the last rule that matches the candidate ignore it?"""
        return next((not negated for p, negated in self.last_first if p.fullmatch(candidate)), False)


ENTRIES = 1000  # of a directory, in one row


def directory_entries(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every directory as ``(…, dir)``, and what stands in it: ``(…, dir, names)``, folders with a slash.

    A directory of many entries is several rows of about ``ENTRIES``.
    """
    parent = P.path_parent("path")
    placed = paths.select(*KEY, "path", F.when(parent == ".", F.lit("")).otherwise(F.concat(parent, F.lit("/"))).alias("dir"))
    files = placed.select(*KEY, "dir", F.expr("substring(path, length(dir) + 1)").alias("name"))
    above = base_dirs(F.concat("dir", F.lit("x")))
    dirs = files.select(*KEY, "dir").distinct().select(*KEY, F.explode(above).alias("dir")).distinct()
    dirs = materialize(dirs, "directories")
    folders = dirs.filter(F.col("dir") != "").select(
        *KEY, F.regexp_extract("dir", "^(.*/)?[^/]+/$", 1).alias("in"), F.regexp_extract("dir", "([^/]+/)$", 1).alias("name")
    )
    entries = files.unionAll(folders.withColumnRenamed("in", "dir")).distinct()
    parts = entries.groupBy(*KEY, "dir").agg(F.ceil(F.count("*") / ENTRIES).alias("parts"))
    part = F.pmod(F.xxhash64("name"), F.col("parts")).alias("part")
    listed = entries.join(parts, [*KEY, "dir"]).groupBy(*KEY, "dir", part).agg(F.collect_list("name").alias("names"))
    return dirs, listed


@F.pandas_udf(ArrayType(BooleanType()))
def _matched(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For every name of a directory: does the last rule that matches the path ignore it?"""
    known: dict[tuple, _Rules] = {}
    for relative, names, specs in batches:
        out = []
        for inside, listed, spec in zip(relative, names, specs, strict=True):
            key = tuple((rule["regex"], rule["negated"]) for rule in spec)
            if key not in known:
                if len(known) > 256:
                    known.clear()
                known[key] = _Rules(key)
            out.append([known[key].matched(inside + name) for name in listed])
        yield pd.Series(out)


def ignored_paths(paths: DataFrame, specs: DataFrame) -> DataFrame:
    """Distinct ignored ``(repo, commit_sha, path)``; any rule file that ignores is enough.

    Rules meet directories, not paths: a rule file travels once with each directory below it.  A path
    is ignored if it is matched itself or lies below a matched directory, which its directory knows.
    """
    dirs, listed = directory_entries(paths)
    above = base_dirs(F.concat("dir", F.lit("x")))
    based = listed.select(*KEY, "dir", "names", F.explode(above).alias("base"))
    met = based.join(specs.select(*KEY, "base", "rules"), [*KEY, "base"])
    relative = F.expr("substring(dir, length(base) + 1)")
    flagged = met.select(*KEY, "dir", F.explode(F.arrays_zip("names", _matched(relative, F.col("names"), F.col("rules")).alias("hit"))).alias("e"))
    hits = flagged.filter("e.hit").select(*KEY, F.concat("dir", "e.names").alias("path")).distinct()
    hits = materialize(hits, "matched")
    chains = dirs.select(*KEY, "dir", F.explode(above).alias("path")).filter(F.col("path") != "")
    closed = chains.join(hits, [*KEY, "path"], "left_semi").select(*KEY, "dir").distinct()
    parent = P.path_parent("path")
    placed = paths.select(*KEY, "path", F.when(parent == ".", F.lit("")).otherwise(F.concat(parent, F.lit("/"))).alias("dir"))
    below = placed.join(closed, [*KEY, "dir"], "left_semi").select(*KEY, "path")
    own = paths.select(*KEY, "path").join(hits, [*KEY, "path"], "left_semi")
    return below.unionAll(own).distinct()


def path_states(tracked: DataFrame, specs: DataFrame) -> DataFrame:
    """Tracked paths of repositories with an ignore file, with ``sensitive`` and ``ignored``."""
    covered = tracked.join(specs.select(*KEY).distinct(), KEY, "left_semi")
    hits = ignored_paths(covered, specs).withColumn("hit", F.lit(True))
    return covered.join(hits, [*KEY, "path"], "left").select(
        *KEY,
        "ord",
        "path",
        P.classify_sensitive("path").alias("sensitive"),
        F.coalesce("hit", F.lit(False)).alias("ignored"),
    )


def tracked_findings(states: DataFrame) -> DataFrame:
    sensitive = F.col("sensitive").isNotNull()
    ignore_file = P.path_name("path") == rules.IGNORE_FILE
    rule = F.when(sensitive & ~F.col("ignored"), F.lit("gitignore.unprotected")).when(
        F.col("ignored") & ~ignore_file, F.lit("gitignore.tracked_ignored")
    )
    severity = (
        F.when(rule == "gitignore.unprotected", F.lit("critical"))
        .when(sensitive, F.lit("high"))
        .otherwise(F.lit("medium"))
    )
    return make_findings(
        states.filter(rule.isNotNull()),
        axis=AXIS,
        rule=rule,
        severity=severity,
        source_ord=0,
        file_path=F.col("path"),
        evidence=F.col("path"),
        params={"name": P.path_name("path")},
        file_ord=F.col("ord"),
    )


def expected_samples() -> list[tuple[str | None, str, str]]:
    """``(ecosystem, label, sample)`` in report order; the first entry applies to everyone."""
    entries = [(None, rules.ENV_SAMPLE, rules.ENV_SAMPLE)]
    for ecosystem in sorted(rules.DEPENDENCY_SAMPLES):
        for sample in rules.DEPENDENCY_SAMPLES[ecosystem]:
            entries.append((ecosystem, sample.split("/")[0], sample))
    return entries


def laid_samples(specs: DataFrame, ecosystems: DataFrame) -> DataFrame:
    """``(…, position, label, path)``: expected samples under each rule file's directory.

    ``ecosystems`` has ``(repo, commit_sha, ecosystems array)``.  Samples are laid out by
    exploding a fixed list.
    """
    samples = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(ecosystem).cast("string").alias("ecosystem"),
                F.lit(label).alias("label"),
                F.lit(sample).alias("sample"),
            )
            for position, (ecosystem, label, sample) in enumerate(expected_samples())
        ]
    )
    applies = F.filter(
        samples,
        lambda s: s["ecosystem"].isNull() | F.array_contains(F.col("ecosystems"), s["ecosystem"]),
    )
    return (
        specs.select(*KEY, "base")
        .join(ecosystems.select(*KEY, "ecosystems"), KEY, "left")
        .withColumn("ecosystems", F.coalesce("ecosystems", F.array().cast("array<string>")))
        .select(*KEY, "base", F.explode(applies).alias("s"))
        .select(*KEY, "s.position", "s.label", F.concat("base", "s.sample").alias("path"))
    )


def missing_ignore_rules(
    specs: DataFrame, ecosystems: DataFrame, ignored: DataFrame | None = None
) -> DataFrame:
    """Expected samples that no directory with an ignore file ignores."""
    laid = laid_samples(specs, ecosystems)
    hits = ignored_paths(laid, specs) if ignored is None else ignored
    return (
        laid.join(hits.withColumn("hit", F.lit(True)), [*KEY, "path"], "left")
        .groupBy(*KEY, "position", "label")
        .agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("covered"))
        .filter(~F.col("covered"))
        .drop("covered")
    )


def rule_findings(missing: DataFrame) -> DataFrame:
    return make_findings(
        missing,
        axis=AXIS,
        rule=F.lit("gitignore.rule_missing"),
        severity=F.lit("medium"),
        source_ord=1,
        evidence=F.col("label"),
        params={"rule": F.col("label")},
        item=F.col("position"),
    )


def absent_findings(scopes: DataFrame, specs: DataFrame) -> DataFrame:
    """One finding for each repository without any ignore file."""
    without = scopes.select(*KEY).join(specs.select(*KEY).distinct(), KEY, "left_anti")
    return make_findings(
        without, axis=AXIS, rule=F.lit("gitignore.missing"), severity=F.lit("high")
    )


def ignore_metrics(scopes: DataFrame, specs: DataFrame, findings: DataFrame) -> DataFrame:
    """Rule files, rules, and the two path findings before merge and cap."""
    per_spec = specs.groupBy(*KEY).agg(
        F.count("*").alias("gitignore_files"), F.sum("rule_count").alias("rules")
    )
    per_rule = findings.groupBy(*KEY).agg(
        F.count_if(F.col("rule") == "gitignore.tracked_ignored").alias("tracked_but_ignored"),
        F.count_if(F.col("rule") == "gitignore.unprotected").alias("unprotected"),
    )
    zero = F.lit(0).cast("long")
    return (
        scopes.select(*KEY)
        .join(per_spec, KEY, "left")
        .join(per_rule, KEY, "left")
        .select(
            *KEY,
            *[
                F.coalesce(c, zero).alias(c)
                for c in ("gitignore_files", "rules", "tracked_but_ignored", "unprotected")
            ],
        )
    )
