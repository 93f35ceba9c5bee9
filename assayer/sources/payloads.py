"""File payloads kept by file, so that a listing meets them without moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.operators import KEY
from assayer.sources import bucketed
from assayer.sources.bucketed import BucketedTable

SCHEMA = (
    "repo STRING, commit_sha STRING, path STRING, http_status INT, encoding STRING, size BIGINT, content_b64 STRING"
)
FILE = [*KEY, "path"]


def open_payloads(spark: SparkSession, path: str, buckets: int = bucketed.BUCKETS) -> BucketedTable:
    """The payload table at ``path``, made with ``buckets`` if there is none."""
    if bucketed.exists(spark, path):
        return bucketed.open_table(spark, path)
    return bucketed.create(spark, path, SCHEMA, FILE, buckets)


def store_payloads(table: BucketedTable, payloads: DataFrame) -> None:
    """Add payloads of files that have none yet; the first payload of a file stays.

    Only the keys of what is stored are read, bucket by bucket; contents move once, into theirs.
    """
    known = table.frame(payloads.sparkSession).select(*FILE).hint("merge")
    bucketed.append(table, payloads.dropDuplicates(FILE).join(known, FILE, "left_anti"))
