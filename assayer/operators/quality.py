"""Quality signals: ecosystems, lockfiles, pinning, complexity, linter reports."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.functions import text as T
from assayer.operators import KEY
from assayer.operators.findings import head_per, make_findings
from assayer.session import small_side

AXIS = "quality_check"


# --- ecosystems ---------------------------------------------------------------------------


def _owner_of(value: Column, table: dict[str, list[str]]) -> Column:
    owners = {entry: ecosystem for ecosystem, entries in table.items() for entry in entries}
    return F.try_element_at(P.literal_map(owners), value)


def ecosystem_facts(tracked: DataFrame) -> DataFrame:
    """Ecosystems seen per repository, and those whose lockfile is absent.

    One aggregation: the sets are bounded by the number of known ecosystems.  An ecosystem
    without a lockfile list is never reported.
    """
    name, suffix = P.path_name("path"), P.lower_suffix("path")
    seen = tracked.groupBy(*KEY).agg(
        F.collect_set(_owner_of(name, rules.MANIFESTS)).alias("by_name"),
        F.collect_set(_owner_of(suffix, rules.SOURCE_EXTENSIONS)).alias("by_suffix"),
        F.collect_set(_owner_of(name, rules.LOCKFILES)).alias("locked"),
    )
    lockable = F.array(*[F.lit(e) for e in rules.LOCKFILES])
    found = F.sort_array(F.array_union("by_name", "by_suffix"))
    return seen.select(
        *KEY,
        found.alias("ecosystems"),
        F.sort_array(F.array_except(F.array_intersect(found, lockable), "locked")).alias(
            "missing_lockfiles"
        ),
    )


def detect_ecosystems(tracked: DataFrame) -> DataFrame:
    return ecosystem_facts(tracked).select(*KEY, F.explode("ecosystems").alias("ecosystem"))


def missing_lockfiles(tracked: DataFrame) -> DataFrame:
    return ecosystem_facts(tracked).select(*KEY, F.explode("missing_lockfiles").alias("ecosystem"))


# --- pinning ------------------------------------------------------------------------------


def pinning(hits: DataFrame) -> DataFrame:
    """Pinned and total requirements per manifest; ``unpinned`` below the ratio."""
    counted = (
        hits.filter(F.col("requirement").isNotNull())
        .groupBy(*KEY, "ord", "path")
        .agg(F.count_if(F.col("requirement") == "pinned").alias("pinned"), F.count("*").alias("total"))
    )
    enough = F.col("total") >= rules.MIN_REQUIREMENTS_FOR_PINNING
    loose = F.col("pinned") / F.col("total") < rules.PINNING_RATIO_THRESHOLD
    return counted.withColumn("unpinned", enough & loose).withColumn("judged", enough)


def pinned_repos(manifests: DataFrame) -> DataFrame:
    """Repositories with at least one judged manifest that is pinned."""
    return manifests.groupBy(*KEY).agg(
        F.bool_or(F.col("judged") & ~F.col("unpinned")).alias("pinned_requirements")
    )


# --- complexity ---------------------------------------------------------------------------

FUNCTIONS = (
    "repo string, commit_sha string, ord long, path string, item int, name string, "
    "line_no int, score int, problem string"
)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
PATHS_ADDED = {
    ast.If: lambda node: 1,
    ast.IfExp: lambda node: 1,
    ast.For: lambda node: 1,
    ast.AsyncFor: lambda node: 1,
    ast.While: lambda node: 1,
    ast.ExceptHandler: lambda node: 1,
    ast.match_case: lambda node: 1,
    ast.BoolOp: lambda node: len(node.values) - 1,
    ast.comprehension: lambda node: 1 + len(node.ifs),
}
# Nothing that counts stands below these, and most nodes of a tree are one of them.
LEAVES = frozenset(
    [ast.Constant, ast.Name, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.Import, ast.ImportFrom, ast.alias]
    + [kind for base in (ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.expr_context) for kind in base.__subclasses__()]
)


def scored_functions(tree: ast.AST) -> list[tuple[ast.AST, int]]:
    """Every function with the branches below it, level by level as ``ast.walk`` meets them.

    Branches belong to the innermost function, those of a nested class to none; one walk serves all
    functions, and nesting may be of any depth.
    """
    found: list[ast.AST] = []
    totals: list[int] = []
    level = [(tree, None)]
    while level:
        below = []
        for node, owner in level:
            for name in node._fields:
                value = getattr(node, name, None)
                for child in value if type(value) is list else (value,):
                    kind = type(child)
                    if kind in LEAVES or not isinstance(child, ast.AST):
                        continue
                    if kind in SCOPES:
                        if kind is ast.ClassDef:
                            below.append((child, None))
                        else:
                            below.append((child, len(found)))
                            found.append(child)
                            totals.append(0)
                        continue
                    if owner is not None and kind in PATHS_ADDED:
                        totals[owner] += PATHS_ADDED[kind](child)
                    below.append((child, owner))
        level = below
    return list(zip(found, totals))


def _python_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["repo", "commit_sha", "ord", "path", "item", "name", "line_no", "score", "problem"]
    for batch in batches:
        rows = []
        for file in batch.itertuples(index=False):
            place = (file.repo, file.commit_sha, file.ord, file.path)
            try:
                tree = ast.parse(file.content)
            except (SyntaxError, ValueError):
                rows.append((*place, None, None, None, None, "syntax"))
                continue
            except (RecursionError, MemoryError):
                rows.append((*place, None, None, None, None, "too_deep"))
                continue
            rows += [
                (*place, i, n.name, n.lineno, 1 + branches, None)
                for i, (n, branches) in enumerate(scored_functions(tree))
            ]
        yield pd.DataFrame(rows, columns=columns)


def _examined(files: DataFrame) -> DataFrame:
    """A map over files: no shuffle, and only Python sources cross into Python."""
    sources = files.filter(P.lower_suffix("path").isin(rules.PYTHON_COMPLEXITY_EXTENSIONS))
    return sources.select(*KEY, "ord", "path", "content").mapInPandas(_python_functions, FUNCTIONS)


def function_complexity(files: DataFrame) -> DataFrame:
    """Cyclomatic complexity per Python function of every file that parses."""
    return _examined(files).filter(F.col("problem").isNull()).drop("problem")


def unparsed_sources(files: DataFrame) -> DataFrame:
    """Per repository, how many Python files do not parse (``syntax``) or are nested deeper than
    the parser goes (``too_deep``)."""
    failed = _examined(files).filter(F.col("problem").isNotNull())
    return failed.groupBy(*KEY, "problem").agg(F.count("*").alias("n_files"))


def complexity_stats(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Per scan; the block is null when no Python file was read."""
    suffix = P.lower_suffix("path")
    owner = _owner_of(suffix, rules.SOURCE_EXTENSIONS)
    sample = files.groupBy(*KEY).agg(
        F.bool_or(suffix.isin(rules.PYTHON_COMPLEXITY_EXTENSIONS)).alias("analyzed"),
        F.sort_array(F.collect_set(F.when(owner != "python", owner))).alias("unanalyzed_languages"),
    )
    score = F.col("score")
    scored = functions.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.count_if(score > rules.COMPLEXITY_THRESHOLD).alias("over"),
        F.max(score).alias("top"),
        F.avg(score).alias("mean"),
    )
    zero = F.lit(0).cast("long")
    return sample.join(scored, KEY, "left").select(
        *KEY,
        F.lit(rules.COMPLEXITY_THRESHOLD).alias("threshold"),
        F.coalesce("n", zero).alias("analyzed_functions"),
        F.when(F.col("analyzed"), F.coalesce("over", zero)).alias("over_threshold"),
        F.when(F.col("analyzed"), F.col("top")).alias("max"),
        F.when(F.col("analyzed"), T.round_to(F.col("mean"), 1)).alias("average"),
        F.when(F.col("analyzed"), F.array(F.lit("python")))
        .otherwise(F.array().cast("array<string>"))
        .alias("analyzed_languages"),
        "unanalyzed_languages",
    )


def complexity_findings(functions: DataFrame) -> DataFrame:
    score = F.col("score")
    high = rules.COMPLEXITY_THRESHOLD * rules.COMPLEXITY_HIGH_FACTOR
    return make_findings(
        functions.filter(score > rules.COMPLEXITY_THRESHOLD),
        axis=AXIS,
        rule=F.lit("quality.complex_function"),
        severity=F.when(score > high, F.lit("high")).otherwise(F.lit("medium")),
        source="ast",
        source_ord=1,
        file_path=F.col("path"),
        line=F.col("line_no"),
        evidence=F.concat(F.lit("def "), F.col("name"), F.lit("(...)")),
        params={
            "name": F.col("name"),
            "score": score,
            "threshold": F.lit(rules.COMPLEXITY_THRESHOLD),
        },
        file_ord=F.col("ord"),
        line_ord=F.lit(0),
        item=F.col("item"),
    )


# --- linter reports -----------------------------------------------------------------------

RUFF_REPORT = (
    "array<struct<code: string, filename: string, location: struct<row: int>, message: string>>"
)
ESLINT_REPORT = (
    "array<struct<filePath: string, "
    "messages: array<struct<ruleId: string, line: int, message: string>>>>"
)
LINTERS = ["ruff", "eslint"]


def lintable(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.filter(P.lower_suffix("path").isin(extensions) & ~T.is_blank("content"))


def ingest_linter_reports(
    reports: DataFrame, limit: int | None = rules.MAX_ISSUES_PER_LINTER
) -> DataFrame:
    """Two report shapes to one issue table, ``limit`` issues per linter in report order.

    Input: ``(repo, commit_sha, report_ord, tool, report)``.  A report may cover one file or a
    whole repository.  Unknown Ruff codes are low, unknown ESLint rules are dropped.
    """
    ruff = (
        reports.filter(F.col("tool") == "ruff")
        .select(*KEY, "report_ord", "tool", F.posexplode(F.from_json("report", RUFF_REPORT)).alias("pos", "r"))
        .select(
            *KEY, "report_ord", "tool", "pos", F.lit(0).alias("sub"),
            F.coalesce("r.code", F.lit("")).alias("rule"),
            F.col("r.filename").alias("file_path"),
            F.col("r.location.row").alias("line"),
            F.coalesce("r.message", F.lit("")).alias("message"),
            F.coalesce(
                F.try_element_at(P.literal_map(rules.RUFF_RULES), F.coalesce("r.code", F.lit(""))),
                F.lit("low"),
            ).alias("severity"),
        )
    )
    eslint = (
        reports.filter(F.col("tool") == "eslint")
        .select(*KEY, "report_ord", "tool", F.posexplode(F.from_json("report", ESLINT_REPORT)).alias("pos", "f"))
        .select(
            *KEY, "report_ord", "tool", "pos",
            F.col("f.filePath").alias("file_path"), F.posexplode("f.messages").alias("sub", "m"),
        )
        .filter(F.col("m.ruleId").isin(list(rules.ESLINT_RULES)))
        .select(
            *KEY, "report_ord", "tool", "pos", "sub",
            F.col("m.ruleId").alias("rule"),
            "file_path",
            F.col("m.line").alias("line"),
            F.coalesce("m.message", F.lit("")).alias("message"),
            F.try_element_at(P.literal_map(rules.ESLINT_RULES), F.col("m.ruleId")).alias("severity"),
        )
    )
    issues = ruff.unionByName(eslint)
    if limit is None:
        return issues
    order = [F.col("report_ord"), F.col("pos"), F.col("sub")]
    return head_per(issues, [*KEY, "tool"], order, limit)


def attach_code_hint(issues: DataFrame, files: DataFrame) -> DataFrame:
    """The stripped source line an issue points at, or the empty text.

    Issues are few (capped per linter), files are not: the places asked for go to the contents,
    and only the lines found come back to the issues.
    """
    place = [*KEY, "file_path", "line"]
    asked = small_side(issues.filter(F.col("line") >= 1).select(*place).distinct())
    texts = files.select(*KEY, F.col("path").alias("file_path"), "content")
    lines = F.split(F.col("content"), r"\r\n|\r|\n", -1)
    found = texts.join(asked, [*KEY, "file_path"]).select(
        *place, T.strip(F.get(lines, F.col("line") - 1)).alias("code_hint")
    )
    return issues.join(found, place, "left").withColumn(
        "code_hint", F.coalesce("code_hint", F.lit(""))
    )


def linter_findings(issues: DataFrame) -> DataFrame:
    """Findings of capped linter issues without the complexity rule, which the parser owns.

    An issue without a source line is told apart by its place in the repository's list; that
    list holds at most one cap per linter.
    """
    tool_ord = F.array_position(F.array(*[F.lit(t) for t in LINTERS]), F.col("tool"))
    window = Window.partitionBy(*KEY).orderBy(
        tool_ord, "report_ord", "pos", "sub"
    )
    kept = issues.filter(F.col("rule") != rules.COMPLEXITY_LINTER_RULE).withColumn(
        "index", F.row_number().over(window) - 1
    )
    identity = F.when(F.col("code_hint") != "", F.col("code_hint")).otherwise(
        F.concat_ws("#", "rule", F.col("index").cast("string"))
    )
    params = {
        "line": F.coalesce(F.col("line").cast("string"), F.lit("?")),
        "message": F.col("message"),
    }
    known = list(rules.RUFF_RULES) + list(rules.ESLINT_RULES)
    # Titles of unknown codes are their own message.
    title = F.when(~F.col("rule").isin(known), F.col("message"))
    shaped = [
        make_findings(
            kept.filter(F.col("tool") == tool),
            axis=AXIS,
            rule=F.col("rule"),
            severity=F.col("severity"),
            source=tool,
            source_ord=0,
            file_path=F.col("file_path"),
            line=F.col("line"),
            evidence=F.col("code_hint"),
            identity=identity,
            title=title,
            params=params,
            line_ord=F.lit(0),
            item=F.col("index"),
        )
        for tool in LINTERS
    ]
    return shaped[0].unionByName(shaped[1])


# --- absence and manifest findings --------------------------------------------------------


def metric_findings(
    facts: DataFrame, samples: DataFrame, pinned: DataFrame, manifests: DataFrame
) -> list[DataFrame]:
    """``facts``: existence flags, ``missing_lockfiles`` per repository."""
    count = F.coalesce("source_files_in_sample", F.lit(0).cast("long"))
    sources = facts.filter(F.col("has_sources")).join(samples, KEY, "left")
    missing = facts.join(pinned, KEY, "left").select(
        *KEY, "pinned_requirements", F.explode("missing_lockfiles").alias("ecosystem")
    )
    softened = (F.col("ecosystem") == "python") & F.coalesce("pinned_requirements", F.lit(False))
    return [
        make_findings(
            sources.filter(~F.col("has_tests")),
            axis=AXIS,
            rule=F.lit("quality.no_tests"),
            severity=F.lit("medium"),
            source="metrics",
            source_ord=2,
            params={"count": count},
        ),
        make_findings(
            sources.filter(~F.col("has_ci")),
            axis=AXIS,
            rule=F.lit("quality.no_ci"),
            severity=F.lit("low"),
            source="metrics",
            source_ord=3,
        ),
        make_findings(
            missing,
            axis=AXIS,
            rule=F.when(softened, F.lit("quality.pinned_without_lockfile")).otherwise(
                F.lit("quality.no_lockfile")
            ),
            severity=F.when(softened, F.lit("info")).otherwise(F.lit("medium")),
            source="metrics",
            source_ord=4,
            identity=F.col("ecosystem"),
            params={"ecosystem": F.col("ecosystem")},
            order_text=F.col("ecosystem"),
        ),
        make_findings(
            manifests.filter(F.col("unpinned")),
            axis=AXIS,
            rule=F.lit("quality.unpinned_dependencies"),
            severity=F.lit("low"),
            source="metrics",
            source_ord=5,
            file_path=F.col("path"),
            params={"pinned": F.col("pinned"), "total": F.col("total")},
            file_ord=F.col("ord"),
        ),
    ]
