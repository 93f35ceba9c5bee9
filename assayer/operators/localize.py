"""Message catalog joins: labels, titles and descriptions in the language of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import rules
from assayer.functions import text as T
from assayer.messages import PARAM_NAMES
from assayer.session import small_side

MAX_MESSAGES = 10_000


def with_template(
    df: DataFrame, catalog: DataFrame, key: Column, lang: Column, name: str
) -> DataFrame:
    """Add column ``name``: the template of ``key`` in ``lang``, else in the default language,
    else the key itself.

    One join, with one row per key.  The catalog is counted: a list of messages, as the built-in one of
    about a hundred keys, is broadcast, one of more than ``MAX_MESSAGES`` meets the rows by shuffle.
    """
    texts = catalog.groupBy(F.col("key").alias("_key")).agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "template"))).alias("_texts")
    )
    texts = small_side(texts, MAX_MESSAGES)
    keyed = df.withColumns({"_key": key, "_lang": T.normalize_lang(lang)})
    exact = F.try_element_at("_texts", F.col("_lang"))
    default = F.try_element_at("_texts", F.lit(rules.DEFAULT_LANGUAGE))
    return (
        keyed.join(texts, "_key", "left")
        .withColumn(name, F.coalesce(exact, default, "_key"))
        .drop("_key", "_lang", "_texts")
    )


def label(
    df: DataFrame, catalog: DataFrame, prefix: str, value: str, lang: Column, name: str,
) -> DataFrame:
    """A display label for ``value``, or the raw value when the catalog has none."""
    key = F.concat(F.lit(f"{prefix}."), F.col(value))
    shown = with_template(df, catalog, key, lang, "_label")
    return shown.withColumn(
        name, F.when(F.col("_label") == key, F.col(value)).otherwise(F.col("_label"))
    ).drop("_label")


def _message_stem() -> Column:
    rule = F.col("rule")
    return (
        F.when(rule == "gitignore.missing", rule)
        .when(rule == "quality.unpinned_dependencies", F.lit("scan.quality.unpinned"))
        .otherwise(F.concat(F.lit("scan."), rule))
    )


def localize_findings(findings: DataFrame, catalog: DataFrame, lang: Column) -> DataFrame:
    """Fill ``title`` and ``description``; run on kept findings, after merge and cap."""
    rule, source = F.col("rule"), F.col("source")
    linter = source.isin("ruff", "eslint")
    plain = source.isin("regex", "filename")
    title_key = (
        F.when(linter, F.concat(F.lit("rule."), rule))
        .when(plain, rule)
        .otherwise(F.concat(_message_stem(), F.lit(".title")))
    )
    description_key = (
        F.when(linter, F.lit("issue.at_line"))
        .when(source == "regex", F.lit("secret.description"))
        .when(source == "filename", F.lit("committed.description"))
        .otherwise(F.concat(_message_stem(), F.lit(".description")))
    )
    titled = with_template(findings, catalog, title_key, lang, "_title")
    both = with_template(titled, catalog, description_key, lang, "description")
    # The description of a dead link names the resolved path, its title the target as written.
    resolved = F.try_element_at(F.col("params"), F.lit("resolved"))
    others = F.map_filter(F.col("params"), lambda name, _: name != "target")
    pointed = F.when(resolved.isNull(), F.col("params")).otherwise(
        F.map_concat(others, F.create_map(F.lit("target"), resolved))
    )
    return both.withColumns(
        {
            "title": F.coalesce(
                F.col("title"), T.fill_template(F.col("_title"), F.col("params"), PARAM_NAMES)
            ),
            "description": T.fill_template(F.col("description"), pointed, PARAM_NAMES),
        }
    ).drop("_title")


def catalog_parity(
    catalog: DataFrame,
    languages: list[str] | None = None,
    reference_lang: str = rules.DEFAULT_LANGUAGE,
) -> DataFrame:
    """``(lang, key, problem)``: missing and extra keys against one language, blank values.

    One aggregation per key; the languages of a report are a fixed short list.
    """
    languages = rules.SUPPORTED_LANGUAGES if languages is None else languages
    present = catalog.groupBy("key").agg(
        F.collect_set("lang").alias("langs"),
        F.bool_or(F.col("lang") == reference_lang).alias("in_reference"),
    )
    expected = F.array(*[F.lit(lang) for lang in languages])
    missing = present.filter("in_reference").select(
        F.explode(F.array_except(expected, "langs")).alias("lang"),
        "key",
        F.lit("missing").alias("problem"),
    )
    extra = present.filter(~F.col("in_reference")).select(
        F.explode("langs").alias("lang"), "key", F.lit("extra").alias("problem")
    )
    blank = catalog.filter(T.is_blank("template")).select(
        "lang", "key", F.lit("blank").alias("problem")
    )
    return missing.unionByName(extra).unionByName(blank)


def recommendations(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per automatic source, in report order, with priority and message key."""
    source = F.col("source")
    order = ["filename", "regex", "ruff", "eslint"]
    message = (
        F.when(source == "filename", F.lit("recommendation.committed_files"))
        .when(source == "regex", F.lit("recommendation.regex_secrets"))
        .otherwise(F.concat(F.lit("recommendation."), source))
    )
    return (
        issues.filter(source.isin(order))
        .groupBy(*keys, "source")
        .agg(F.count("*").alias("count"))
        .select(
            *keys,
            "source",
            "count",
            F.when(source.isin("filename", "regex"), F.lit("high")).otherwise(F.lit("medium")).alias("priority"),
            message.alias("message_key"),
            F.array_position(F.array(*[F.lit(o) for o in order]), source).alias("place"),
        )
    )
