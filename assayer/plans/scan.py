"""From a listing and payloads to reports per repository and commit."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import paths as P
from assayer.operators import KEY, coverage, documents, findings, ignore, lines, quality, secrets
from assayer.operators.lines import SecretRule
from assayer.operators.localize import localize_findings, with_template
from assayer.session import materialize
from assayer.sources import tree as listing
from assayer.sources.bucketed import BucketedTable


def _plain(value: object) -> object:
    """A rule value as JSON can write it, the same in every process."""
    if isinstance(value, dict):
        return [[_plain(k), _plain(v)] for k, v in value.items()]
    if isinstance(value, (set, frozenset)):
        return sorted(map(str, value))
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else repr(value)


def config_hash(source: object = rules) -> str:
    """Part of the cache key: a digest over every rule table and limit that ``rules`` holds.

    All constants count, whatever reads them, so a changed rule never serves an old scan.
    """
    constants = {name: _plain(value) for name, value in vars(source).items() if name.isupper()}
    written = json.dumps(constants, sort_keys=True, ensure_ascii=True)
    return hashlib.sha256(written.encode("ascii")).hexdigest()[: rules.CONFIG_HASH_LENGTH]


def config_hash_column(inputs: Column) -> Column:
    """The same digest for rule sets kept as rows."""
    return F.substring(F.sha2(F.to_json(inputs), 256), 1, rules.CONFIG_HASH_LENGTH)


@dataclass
class Prepared:
    tracked: DataFrame
    files: DataFrame
    coverage: DataFrame


def prepare_files(
    tree: DataFrame,
    payloads: DataFrame | BucketedTable,
    max_files: int | None = rules.MAX_REPO_FILES,
    max_size: int = rules.MAX_FILE_SIZE,
    written: bool = False,
    **guards: int,
) -> Prepared:
    """Select, cap and read files, and account for every tracked one.

    Selection and cap (None: no cap) work on the listing alone; only payloads of kept files are
    decoded.  Payloads meet the kept files on ``(repo, commit_sha, path)``, a key without hot
    values: of a stored payload table (``sources.payloads``) no contents move, the listing goes to
    them.  ``written`` keeps the decoded files in the shared folder, for plans that read them more
    than once.
    """
    stored = isinstance(payloads, BucketedTable)
    payloads = payloads.frame(tree.sparkSession) if stored else payloads
    tracked = listing.tracked_paths(tree)
    eligible = coverage.with_rejection(tracked, max_size).filter(F.col("reason").isNull())
    kept = eligible.drop("reason", "type", "truncated")
    if max_files is not None:
        kept = coverage.cap_files(kept, max_files)
    payload = payloads.select(
        *KEY, "path", "http_status", "encoding", F.col("size").alias("payload_size"), "content_b64"
    )
    payload = payload.hint("merge") if stored else payload
    attempts = listing.decode_contents(
        kept.join(payload, [*KEY, "path"], "left"), size="payload_size", **guards
    )
    if written:
        attempts = materialize(attempts, "files")
    counts = coverage.file_counts(tracked, attempts.select(*KEY, "outcome"), max_files, max_size)
    files = listing.readable(attempts).drop("outcome", "http_status", "encoding", "payload_size")
    return Prepared(
        tracked=tracked.select(*KEY, "ord", "path"),
        files=files.withColumn("language", P.file_language("path")),
        coverage=coverage.coverage(counts, tree),
    )


def scopes_of(tracked: DataFrame) -> DataFrame:
    return tracked.select(*KEY).distinct()


def secrets_axis(
    files: DataFrame, hits: DataFrame | None = None, secret_rules: list[SecretRule] | None = None
) -> DataFrame:
    """Findings of the secrets axis, before merge and cap."""
    hits = lines.line_hits(files, ("secret",), secret_rules) if hits is None else hits
    return findings.union_findings(
        secrets.scan_sensitive_files(files), secrets.secret_findings(hits, secret_rules)
    )


def repo_facts(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """One row per repository: existence flags, ecosystems, lockfiles, ``documented``.

    The axes need these in several places; all are partial aggregates over metadata.
    """
    documented = files.groupBy(*KEY).agg(F.bool_or(P.is_markdown("path")).alias("documented"))
    return (
        coverage.repo_flags(tracked)
        .join(quality.ecosystem_facts(tracked), KEY)
        .join(documented, KEY, "left")
        .withColumn("documented", F.coalesce("documented", F.lit(False)))
    )


def ignore_axis(
    files: DataFrame,
    tracked: DataFrame,
    facts: DataFrame | None = None,
    specs: DataFrame | None = None,
) -> DataFrame:
    """Findings of the ignore axis; a repository without ignore file gets exactly one.

    Facts and rules are written once where they are not given, as several branches read them:
    the contents are read once, whatever their size.
    """
    facts = materialize(repo_facts(files, tracked), "facts") if facts is None else facts
    specs = materialize(ignore.ignore_specs(files), "specs") if specs is None else specs
    return findings.union_findings(
        ignore.absent_findings(facts, specs),
        ignore.tracked_findings(ignore.path_states(tracked, specs)),
        ignore.rule_findings(ignore.missing_ignore_rules(specs, facts)),
    )


def quality_axis(
    files: DataFrame,
    tracked: DataFrame,
    linter_reports: DataFrame | None = None,
    hits: DataFrame | None = None,
    facts: DataFrame | None = None,
    functions: DataFrame | None = None,
    issues: DataFrame | None = None,
) -> DataFrame:
    """Findings of the quality axis; ``functions`` and ``issues`` are what is known of them already."""
    facts = materialize(repo_facts(files, tracked), "facts") if facts is None else facts
    hits = materialize(lines.line_hits(files, ("requirement",)), "hits") if hits is None else hits
    functions = quality.function_complexity(files) if functions is None else functions
    manifests = quality.pinning(hits)
    parts = [
        quality.complexity_findings(functions),
        *quality.metric_findings(
            facts, coverage.sample_counts(files), quality.pinned_repos(manifests), manifests
        ),
    ]
    if issues is None and linter_reports is not None:
        issues = linter_issues(linter_reports, files)
    if issues is not None:
        parts.insert(0, quality.linter_findings(issues))
    return findings.union_findings(*parts)


def linter_issues(reports: DataFrame, files: DataFrame) -> DataFrame:
    return quality.attach_code_hint(quality.ingest_linter_reports(reports), files)


def docs_axis(
    files: DataFrame,
    tracked: DataFrame,
    hits: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Findings of the documentation axis, for repositories with at least one document."""
    facts = materialize(repo_facts(files, tracked), "facts") if facts is None else facts
    kinds = ("links", "env", "declared", "tokens")
    hits = materialize(lines.line_hits(files, kinds), "hits") if hits is None else hits
    used = documents.first_usage(documents.env_usage(hits))
    declared = documents.env_declared(hits)
    mentioned = documents.doc_mentions(hits)
    broken = documents.broken_links(documents.extract_links(hits), tracked)
    everything = findings.union_findings(
        documents.link_findings(broken),
        *documents.env_findings(
            documents.undocumented_env(used, declared, mentioned),
            documents.unused_env(declared, used),
            documents.missing_env_template(used, facts),
        ),
    )
    return everything.join(facts.filter("documented").select(*KEY), KEY, "left_semi")


def axis_metrics(
    files: DataFrame,
    tracked: DataFrame,
    hits: DataFrame,
    specs: DataFrame,
    facts: DataFrame,
    ignored: DataFrame,
    functions: DataFrame,
    issues: DataFrame | None = None,
) -> DataFrame:
    """One row per scan: what each axis counted, as ``ignore``, ``quality`` and ``docs``.

    ``ignored`` are the findings of the ignore axis before merge.  All inputs but the paths of
    ``files`` are narrow; lists are bounded by the known ecosystems, or are a repository's pipelines.
    """
    zero = F.lit(0).cast("long")
    used = documents.first_usage(documents.env_usage(hits))
    parts = [
        _packed(ignore.ignore_metrics(facts, specs, ignored), "ignore"),
        _packed(documents.doc_metrics(files, facts, used, documents.env_declared(hits)).drop("available"), "docs"),
    ]
    counted = quality.pinned_repos(quality.pinning(hits))
    checked = (
        facts.select(*KEY, "ecosystems", "has_sources", "has_tests", "has_ci", "missing_lockfiles")
        .join(coverage.sample_counts(files), KEY, "left")
        .join(coverage.ci_files(tracked), KEY, "left")
        .join(counted, KEY, "left")
        .join(_packed(quality.complexity_stats(files, functions), "complexity"), KEY, "left")
    )
    if issues is None:
        checked = checked.withColumn("linter_issues", zero)
    else:
        own = issues.filter(F.col("rule") != rules.COMPLEXITY_LINTER_RULE).groupBy(*KEY).agg(F.count("*").alias("linter_issues"))
        checked = checked.join(own, KEY, "left")
    checked = checked.withColumns(
        {
            "ci_files": F.coalesce("ci_files", F.array().cast("array<string>")),
            "pinned_requirements": F.coalesce("pinned_requirements", F.lit(False)),
            **{c: F.coalesce(c, zero) for c in ("source_files_in_sample", "test_files_in_sample", "linter_issues")},
        }
    )
    parts.append(_packed(checked, "quality"))
    joined = facts.select(*KEY)
    for part in parts:
        joined = joined.join(part, KEY, "left")
    return joined


def _packed(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*KEY, F.struct(*[c for c in rows.columns if c not in KEY]).alias(name))


@dataclass
class Scan:
    statuses: DataFrame
    findings: DataFrame
    summary: DataFrame
    metrics: DataFrame
    coverage: DataFrame | None


def run_scan(
    files: DataFrame,
    tracked: DataFrame,
    coverage_rows: DataFrame | None = None,
    linter_reports: DataFrame | None = None,
    secret_rules: list[SecretRule] | None = None,
    catalog: DataFrame | None = None,
    lang: str = rules.DEFAULT_LANGUAGE,
    limit: int | None = rules.MAX_FINDINGS_PER_AXIS,
) -> Scan:
    """All four axes of every repository: statuses, findings (at most ``limit`` an axis; None: all),
    summary, the metrics of the axes and the coverage that was given.

    Contents are split into lines once: the narrow table of hits feeds three axes.  Ignore rules,
    facts per repository, functions, linter issues and merged findings are written once as well, since
    several branches read each of them.  An axis that could not run carries a ``message``.
    """
    hits = materialize(lines.line_hits(files, lines.HIT_KINDS, secret_rules), "hits")
    specs = materialize(ignore.ignore_specs(files), "specs")
    facts = materialize(repo_facts(files, tracked), "facts")
    functions = materialize(quality.function_complexity(files), "functions")
    issues = None if linter_reports is None else materialize(linter_issues(linter_reports, files), "issues")
    ignored = materialize(ignore_axis(files, tracked, facts, specs), "ignored")
    found = findings.union_findings(
        secrets_axis(files, hits, secret_rules),
        ignored,
        quality_axis(files, tracked, hits=hits, facts=facts, functions=functions, issues=issues),
        docs_axis(files, tracked, hits, facts),
    )
    merged = materialize(findings.merge_findings(found), "merged")
    closed = F.when(F.col("documented"), F.array().cast("array<string>")).otherwise(
        F.array(F.lit(documents.AXIS))
    )
    scopes = facts.select(*KEY, closed.alias("unavailable"))
    statuses = findings.axis_statuses(scopes, findings.axis_counts(merged, limit))
    if coverage_rows is not None:
        gaps = coverage.complete(coverage_rows).select(*KEY, "complete")
        statuses = statuses.join(gaps, KEY, "left").withColumn(
            "complete", F.coalesce("complete", F.lit(True))
        )
    else:
        statuses = statuses.withColumn("complete", F.lit(True))
    statuses = statuses.withColumn(
        "status", findings.downgrade_status(F.col("status"), F.col("complete"))
    )
    kept = findings.rank_findings(merged, limit)
    if catalog is not None:
        kept = localize_findings(kept, catalog, F.lit(lang))
        key = F.when(F.col("status") == "unavailable", F.lit("recommendation.no_readme"))
        statuses = with_template(statuses, catalog, key, F.lit(lang), "message")
    else:
        statuses = statuses.withColumn("message", F.lit(None).cast("string"))
    metrics = axis_metrics(files, tracked, hits, specs, facts, ignored, functions, issues)
    return Scan(statuses, kept, findings.scan_summary(statuses, kept), metrics, coverage_rows)


def scan_repositories(
    tree: DataFrame, payloads: DataFrame | BucketedTable, max_files: int | None = rules.MAX_REPO_FILES,
    max_size: int = rules.MAX_FILE_SIZE, guards: dict[str, int] | None = None, **options: object,
) -> Scan:
    """From a listing and payloads to the scan: files are selected, capped, decoded once and audited,
    with absence judged over all tracked paths.  ``options`` go to ``run_scan``."""
    ready = prepare_files(tree, payloads, max_files, max_size, written=True, **(guards or {}))
    return run_scan(ready.files, ready.tracked, ready.coverage, **options)


def scan_payloads(scan: Scan, lang: str = rules.DEFAULT_LANGUAGE) -> DataFrame:
    """``(repo, commit_sha, payload)``: one JSON document per scan, as the cache stores it.

    It holds the coverage, four axes in their order (status, metrics, message, capped findings) and
    the summary; what is null is left out.
    """
    body = [c for c in scan.findings.columns if c not in (*KEY, "axis", "ord")]
    listed = scan.findings.groupBy(*KEY, "axis").agg(
        F.array_sort(
            F.collect_list(F.struct(*body)), lambda a, b: a["rank"] - b["rank"]
        ).alias("findings")
    )
    owner = {"ignore": ignore.AXIS, "quality": quality.AXIS, "docs": documents.AXIS}
    shown = []
    for name, axis in owner.items():
        wanted = (F.col("axis") == axis) & (F.col("status") != "unavailable")
        for field in scan.metrics.schema[name].dataType.names:
            shown.append(F.when(wanted, F.col(name)[field]).alias(field))
    entry = F.struct(
        F.array_position(F.array(*[F.lit(a) for a in rules.AXES]), F.col("axis")).alias("place"),
        F.struct(
            "axis", "status", "dropped", F.struct(*shown).alias("metrics"), "message",
            F.coalesce("findings", F.array()).alias("findings"),
        ).alias("axis"),
    )
    axes = (
        scan.statuses.join(listed, [*KEY, "axis"], "left")
        .join(scan.metrics, KEY, "left")
        .groupBy(*KEY)
        .agg(
            F.first("complete").alias("complete"),
            # maps do not compare, places do
            F.array_sort(F.collect_list(entry), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("axes"),
        )
    )
    covered = F.lit(None).cast("struct<tracked_files: bigint>")
    if scan.coverage is not None:
        axes = axes.join(_packed(scan.coverage, "coverage"), KEY, "left")
        covered = F.col("coverage")
    return axes.join(scan.summary, KEY).select(
        *KEY,
        F.to_json(
            F.struct(
                F.lit(rules.SCAN_VERSION).alias("scan_version"),
                F.lit(lang).alias("language"),
                covered.alias("coverage"),
                "complete",
                F.transform("axes", lambda a: a["axis"]).alias("axes"),
                F.struct("findings", "dropped", *rules.SEVERITIES, "axes_with_issues").alias("summary"),
            )
        ).alias("payload"),
    )
