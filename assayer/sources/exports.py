"""Report export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators.localize import label


def iso(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def labelled_results(runs: DataFrame, results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Result rows with aspect and status labels in the language of their run."""
    langs = runs.select(F.col("id").alias("analysis_id"), T.normalize_lang("language").alias("lang"))
    shown = results.join(langs, "analysis_id")
    shown = label(shown, catalog, "aspect", "aspect", F.col("lang"), "aspect_label")
    return label(shown, catalog, "result", "status", F.col("lang"), "status_label")


def export_reports(runs: DataFrame, results: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(id, report)``: one JSON document per run; write it with ``df.write.text``/``json``.

    A run has one result per aspect, which bounds the list in a document.
    """
    fields = [
        "aspect", "aspect_label", "status", "status_label",
        *[c for c in ("issues", "recommendations") if c in results.columns],
    ]
    listed = (
        labelled_results(runs, results, catalog)
        .groupBy("analysis_id")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))
    )
    joined = runs.join(listed, runs["id"] == listed["analysis_id"], "left")
    return joined.select(
        "id",
        F.to_json(
            F.struct(
                "repo_name",
                "repo_sha",
                "status",
                T.normalize_lang("language").alias("language"),
                iso("created_at").alias("created_at"),
                iso("completed_at").alias("completed_at"),
                "results",
            )
        ).alias("report"),
    )
