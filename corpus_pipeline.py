"""A corpus cleaned in five stages, each one operator of ``assayer.llm``.

A stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and returns the rows that it
keeps, with the columns of ``documents``; the last adds ``n_tokens, posterior, rate, copies``.
Stages write what they read more than once to the shared folder; ``run`` puts every stage's result
there too.

Extra columns stay as they are, also those named like an operator's own; the last stage replaces columns
named like those that it adds, whatever their case.  Texts of any length are read whole; null texts count as
empty ones, and among equal candidates the id decides, as each stage says.

Defined results: a null id is no name, so stages that decide by id (near copies, contamination)
keep its rows, and of near copies only those with ids are compared; rows with equal ids share the
decisions of these two stages; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality
from assayer.llm.common import drop_ids, keep_rows, prepare, read_table
from assayer.llm.queries import labelled_domains
from assayer.session import materialize

# Junk has gone by then: shares of tokens for junk, toxic and clean documents.
MIXTURE = (0.0, 0.05, 0.95)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer does not reject."""
    prepare(spark)
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    prepare(spark)
    # digests of this stage alone: the driver commits and lists a file per bucket in every range
    buckets = min(exact_dedup.BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = exact_dedup.open_index(spark, buckets=buckets)
    kept = exact_dedup.dedup_ranges(index, docs).filter("kept").select("id", "digest")
    exact_dedup.close_index(spark, index)
    keys = {"id": F.col("doc_id").cast("bigint"), "digest": exact_dedup.digest_of(F.col("text"))}
    return keep_rows(docs, kept, keys)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest id."""
    prepare(spark)
    named = docs.filter(F.col("doc_id").isNotNull())
    found = jaccard_join.similar_components(named, shingle=5, percent=80)
    return drop_ids(docs, found.filter("id <> component_id").select("id"), "doc_id")


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate."""
    prepare(spark)
    judged = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    bad = judged.filter(F.col("contaminated") & F.col("doc_id").isNotNull())
    return drop_ids(docs, bad.select(F.col("doc_id").alias("id")), "doc_id")


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: ``copies`` tells how often, none at all goes."""
    prepare(spark)
    return mixing.mix(docs, labelled_domains(spark, sf_dir), MIXTURE).filter("copies > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", contaminated),
    ("mixing sources to target weights", target_mixture),
]
# The classifiers are fitted, which SQL does not state; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
