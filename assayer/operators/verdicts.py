"""Prompt tables out, model answers in: validation and merge of verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assayer import rules
from assayer.functions import text as T
from assayer.operators import KEY
from assayer.session import materialize

ENTRIES = "struct<verdicts: array<struct<finding_id: string, verdict: string, reason: string>>>"


def submitted(issues: DataFrame, per_call: int = rules.MAX_FINDINGS_PER_CALL) -> DataFrame:
    """Issues with an id, and the ``call`` that covers each: ``per_call`` of an axis in report order.

    Calls are numbered from 0; every issue with an id is in one, however many an axis has.
    """
    named = issues.filter(F.coalesce("id", F.lit("")) != "")
    place = F.row_number().over(Window.partitionBy(*KEY, "axis").orderBy("place"))
    return named.withColumn("nth", place).withColumn("call", F.floor((F.col("nth") - 1) / per_call).cast("int"))


def triage_line() -> Column:
    """One issue as a prompt line; optional parts are left out when empty."""
    lines = F.filter(F.col("locations.line"), lambda n: n.isNotNull() & (n != 0))

    def part(name: str, value: Column, default: str | None = None) -> Column:
        shown = F.coalesce(value, F.lit(default)) if default is not None else F.nullif(value, F.lit(""))
        return F.concat(F.lit(f"{name}="), shown)

    return F.concat(
        F.lit("- "),
        F.concat_ws(
            " | ",
            part("id", F.col("id"), ""),
            part("regle", F.col("rule"), "?"),
            part("severite", F.col("severity"), "?"),
            part("fichier", F.col("file_path"), "N/A"),
            part("lignes", F.array_join(F.transform(lines, lambda n: n.cast("string")), ",")),
            part("context", F.col("context")),
            part("titre", F.col("title"), ""),
            part("extrait", F.col("code_hint")),
        ),
    )


def triage_prompts(
    issues: DataFrame, instructions: str = "", per_call: int = rules.MAX_FINDINGS_PER_CALL
) -> DataFrame:
    """Prompts over the issues of each scan and axis, in report order, ``per_call`` to a prompt.

    ``call`` numbers the prompts of an axis as ``submitted`` does.
    """
    listed = (
        submitted(issues, per_call)
        .withColumn("entry", triage_line())
        .groupBy(*KEY, "axis", "call")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "entry"))).alias("entries"))
    )
    body = F.array_join("entries.entry", "\n")
    return listed.select(
        *KEY, "axis", "call", F.concat_ws("\n\n", F.nullif(F.lit(instructions), F.lit("")), body).alias("prompt")
    )


Templates = dict[tuple[str, str], str]


def discovery_prompts(contexts: DataFrame, templates: str | Templates) -> DataFrame:
    """Prompts from retrieved contexts: the template with ``{context}`` filled in.

    One template for all, or templates by axis and language: rows then have ``axis`` and
    ``language``, a language without a template falls back to the default one, and an axis
    without any has no prompt.
    """
    if isinstance(templates, str):
        template = F.lit(templates)
    else:
        known = F.create_map(*[F.lit(x) for (axis, lang), t in templates.items() for x in (f"{axis}/{lang}", t)])
        lang = T.normalize_lang("language")
        own = F.try_element_at(known, F.concat_ws("/", "axis", lang))
        template = F.coalesce(
            own, F.try_element_at(known, F.concat_ws("/", "axis", F.lit(rules.DEFAULT_LANGUAGE)))
        )
    filled = contexts.withColumn("prompt", F.replace(template, F.lit("{context}"), F.col("context")))
    return filled.filter(F.col("prompt").isNotNull())


def score_prompts(
    prompts: DataFrame, model: Callable[[pd.Series], pd.Series], column: str = "prompt"
) -> DataFrame:
    """All columns of ``prompts`` and ``raw``, the model's answers.

    ``model`` maps a series of prompts to answers of the same length; it is called once per Arrow
    batch inside the tasks.  Answers are written before they are returned, so a later action or
    a lost executor of one never asks again for what was answered.
    """

    @F.pandas_udf(StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield model(batch)

    return materialize(prompts.withColumn("raw", ask(F.col(column))), "answers")



def _by_call(rows: DataFrame) -> DataFrame:
    """Rows with the number of their call; where none is kept there was one call an axis."""
    call = F.coalesce("call", F.lit(0)).cast("int") if "call" in rows.columns else F.lit(0)
    return rows.withColumn("call", call)


CALL = [*KEY, "axis", "call"]


def _listed(allowed: DataFrame) -> DataFrame:
    """The ids that each call was sent."""
    sent = _by_call(allowed).select(*CALL, F.col("id").alias("finding_id")).distinct()
    return sent.withColumn("known", F.lit(True))


def _parsed(answers: DataFrame) -> DataFrame:
    entries = F.from_json(T.strip_fences("raw"), ENTRIES)["verdicts"]
    return _by_call(answers).select(*CALL, entries.alias("verdicts"))


def _on_list() -> Column:
    return F.coalesce("known", F.lit(False)) & F.coalesce(F.col("verdict").isin(rules.VERDICTS), F.lit(False))


def validate_verdicts(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Verdicts of answers that keep to the closed list; one bad entry rejects its answer alone.

    ``answers``: ``(repo, commit_sha, axis, call, raw)``, one per call; ``allowed``: what was sent,
    ``(repo, commit_sha, axis, call, id)``.  An answer may name the ids of its own call only.  A
    malformed element makes the parsed list null, which rejects the answer as well.  The first
    verdict for an id wins, in the order of calls.
    """
    scope = [*KEY, "axis"]
    parsed = _parsed(answers).filter(F.col("verdicts").isNotNull())
    entries = parsed.select(*CALL, F.posexplode("verdicts").alias("pos", "v"))
    checked = (
        entries.select(*CALL, "pos", "v.*")
        .join(_listed(allowed), [*CALL, "finding_id"], "left")
        .withColumn("valid", _on_list())
    )
    # What is listed per answer are the entries of one answer, itself one row.
    accepted = (
        checked.groupBy(*CALL)
        .agg(
            F.bool_and("valid").alias("accepted"),
            F.collect_list(F.struct("finding_id", "pos", "verdict", "reason")).alias("entries"),
        )
        .filter("accepted")
        .select(*CALL, F.explode("entries").alias("e"))
        .select(*CALL, "e.*")
    )
    reason = T.truncate(F.coalesce("first.reason", F.lit("")), rules.MAX_REASON_LENGTH)
    return (
        accepted.groupBy(*scope, "finding_id")
        .agg(F.min_by(F.struct("verdict", "reason"), F.struct("call", "pos")).alias("first"))
        .select(*scope, "finding_id", F.col("first.verdict").alias("verdict"), reason.alias("reason"))
    )


def answer_statuses(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """``accepted`` or ``error`` per call; an empty list is accepted."""
    checked = (
        _parsed(answers).select(*CALL, "verdicts", F.explode_outer("verdicts").alias("v"))
        .select(
            *CALL,
            F.col("verdicts").isNotNull().alias("is_list"),
            (F.coalesce(F.size("verdicts"), F.lit(0)) == 0).alias("is_empty"),
            F.col("v.finding_id").alias("finding_id"),
            F.col("v.verdict").alias("verdict"),
        )
        .join(_listed(allowed), [*CALL, "finding_id"], "left")
    )
    valid = F.col("is_list") & (F.col("is_empty") | _on_list())
    return checked.groupBy(*CALL).agg(
        F.when(F.bool_and(valid), F.lit("accepted")).otherwise(F.lit("error")).alias("status")
    )


def apply_verdicts(issues: DataFrame, verdicts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Attach verdicts; a false positive is demoted and keeps its severity aside, no row goes."""
    keys = [*KEY, "axis"] if keys is None else keys
    decided = verdicts.select(
        *keys, F.col("finding_id").alias("id"), "verdict", F.col("reason").alias("verdict_reason")
    )
    demoted = F.coalesce(F.col("verdict") == rules.FALSE_POSITIVE, F.lit(False))
    return (
        issues.join(decided, [*keys, "id"], "left")
        .withColumn("original_severity", F.when(demoted, F.col("severity")))
        .withColumn("severity", F.when(demoted, F.lit(rules.DEMOTED_SEVERITY)).otherwise(F.col("severity")))
    )


def flag_known_paths(issues: DataFrame, tracked: DataFrame) -> DataFrame:
    paths = tracked.select(*KEY, F.col("path").alias("file_path")).distinct()
    return issues.join(paths.withColumn("known", F.lit(True)), [*KEY, "file_path"], "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def reject_unknown_paths(issues: DataFrame, tracked: DataFrame) -> DataFrame:
    """Issues on tracked paths; the others name files the repository does not have."""
    return flag_known_paths(issues, tracked).filter("known").drop("known")


def rejected_counts(issues: DataFrame, tracked: DataFrame) -> DataFrame:
    return (
        flag_known_paths(issues, tracked)
        .groupBy(*KEY)
        .agg(F.count_if("known").alias("kept"), F.count_if(~F.col("known")).alias("rejected"))
    )


def merge_ai(
    base_issues: DataFrame,
    base_statuses: DataFrame,
    triaged: DataFrame,
    discovered: DataFrame,
    tracked: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Issues and statuses after the model's answers.

    Triage axes take the triaged list, or the base list where that is empty; discovery axes add
    the model's own issues on tracked paths.  All inputs carry ``(repo, commit_sha, axis)``.
    """
    scope = [*KEY, "axis"]
    is_triage = F.col("axis").isin(rules.TRIAGE_AXES)
    replaced = triaged.filter(is_triage)
    untouched = base_issues.filter(is_triage).join(replaced.select(*scope).distinct(), scope, "left_anti")
    own = discovered.filter(~is_triage & (F.coalesce("source", F.lit("llm")) == "llm"))
    issues = (
        replaced.unionByName(untouched, allowMissingColumns=True)
        .unionByName(base_issues.filter(~is_triage), allowMissingColumns=True)
        .unionByName(reject_unknown_paths(own, tracked), allowMissingColumns=True)
    )
    counts = issues.groupBy(*scope).agg(F.count("*").alias("n_issues"))
    status = F.when(F.coalesce("n_issues", F.lit(0)) > 0, F.lit("issues_found")).otherwise(F.col("status"))
    statuses = base_statuses.join(counts, scope, "left").withColumn("status", status)
    return issues, statuses.withColumn("n_issues", F.coalesce("n_issues", F.lit(0).cast("long")))


def all_failed(results: DataFrame, keys: list[str]) -> DataFrame:
    """Scans all of whose agents ended in error."""
    return results.groupBy(*keys).agg(F.bool_and(F.col("status") == "error").alias("all_failed"))
