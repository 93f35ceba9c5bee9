"""Exact deduplication against a persistent index of digests.

The index is a Parquet table, bucketed and sorted by digest.  A batch of new documents is reduced
to distinct digests, a sort-merge anti-join with the index leaves those that are new, and these are
appended.  The index side of the join is read in its buckets and is never shuffled.

Defined results: a null text counts as empty, so do texts without characters; null ids sort below
all others and stay only in groups that have no other id; of repeated rows (same id, equal text)
one stays; an empty batch appends nothing and returns no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import ascii_lower, prepare
from assayer.session import materialize, new_table_path

BUCKETS = 256  # no fewer than the tasks that write, so that each writes one file
PARTS = 3


@dataclass(frozen=True)
class DigestIndex:
    """Where an index lies, and in how many buckets; ``table`` is its name in this session."""

    path: str
    buckets: int
    table: str


def open_index(spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> DigestIndex:
    """Open the index at ``path``, or a new one in the shared folder.

    The number of buckets belongs to the index; choose it by the bytes expected (a bucket of a
    few hundred MB), as a later batch has to name the same number.
    """
    path = path or new_table_path(spark, "digest-index")
    table = f"digest_index_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return DigestIndex(path, buckets, table)


def close_index(spark: SparkSession, index: DigestIndex) -> None:
    """Forget the name in this session; the files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {index.table}")


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null as the empty text."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def dedup_batch(
    index: DigestIndex, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str | None = None
) -> DataFrame:
    """Deduplicate a batch within itself and against the index, and append what is new.

    Returns one row per document: ``id, digest, keep_id, group_size, kept``.  ``keep_id`` is the
    largest id of the equal texts of the batch in which the text was first seen, ``group_size``
    the number of equal texts in this batch.  ``name`` tells the batch from others; one without
    can not be sent again.
    """
    return _each(_decided(index, _digests(docs, id_column, text_column), name or uuid.uuid4().hex))


def _digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"), digest_of(F.col(f"`{text_column}`")).alias("digest")
    )


def dedup_ranges(
    index: DigestIndex, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    name: str | None = None, parts: int = PARTS,
) -> DataFrame:
    """Deduplicate ``docs`` as ``parts`` batches, one range of ids after another from the largest on.

    Each batch meets the index that the ones before have filled, so a text stays at its largest id;
    ``group_size`` counts the equal texts of all batches.  Null ids come last.
    """
    name = name or uuid.uuid4().hex
    digests = materialize(_digests(docs, id_column, text_column), "digests")
    id_ = F.col("id")
    ends = digests.agg(F.min(id_).alias("least"), F.max(id_).alias("most")).first()
    least, most = ends["least"] or 0, ends["most"] or 0
    width = (most - least) // parts + 1
    decided = None
    for part in range(parts):
        place = F.when(id_.isNull(), parts - 1).otherwise(F.floor((F.lit(most) - id_) / width))
        batch = _decided(index, digests.filter(place == part), f"{name}/{part}")
        decided = batch if decided is None else decided.unionAll(batch)
    sizes = decided.groupBy("digest").agg(F.sum("times").alias("all_times"))
    together = decided.join(sizes.hint("merge"), "digest").withColumn("group_size", F.col("all_times"))
    return _each(together.drop("all_times"))


def _decided(index: DigestIndex, digests: DataFrame, batch: str) -> DataFrame:
    """``id, digest, keep_id, group_size, times, stays`` of the different rows of a batch."""
    spark = digests.sparkSession
    # Repeated rows are counted before anything moves by digest alone, so a group of copies
    # that holds a third of all rows reaches each task as one partial count.
    rows = materialize(digests.groupBy("digest", "id").agg(F.count("*").alias("times")), "digests")
    groups = rows.groupBy("digest").agg(
        F.max("id").alias("max_id"), F.sum("times").alias("group_size")
    )
    known = spark.table(index.table).select("digest").hint("merge")
    fresh = groups.join(known, "digest", "left_anti").select(
        "digest", F.col("max_id").alias("keep_id"), F.lit(batch).alias("batch")
    )
    fresh.repartition(index.buckets, "digest").sortWithinPartitions("digest").write.insertInto(
        index.table
    )
    spark.catalog.refreshTable(index.table)
    # Written before the join with the rows: both sides then arrive by a plain exchange, which
    # adaptive execution can split where one digest is hot.
    decided = materialize(
        groups.join(spark.table(index.table).hint("merge"), "digest").select(
            "digest", "keep_id", "group_size", (F.col("batch") == batch).alias("new")
        ),
        "decided",
    )
    joined = rows.join(decided.hint("merge"), "digest")
    stays = F.col("new") & F.col("id").eqNullSafe(F.col("keep_id"))
    return joined.select("id", "digest", "keep_id", "group_size", "times", stays.alias("stays"))


def _each(decided: DataFrame) -> DataFrame:
    """One row per document; of equal rows the first may stay."""
    copies = F.sequence(F.lit(1).cast("bigint"), "times")
    return decided.select(
        "id", "digest", "keep_id", "group_size",
        F.explode(F.transform(copies, lambda k: F.col("stays") & (k == 1))).alias("kept"),
    )
