"""Scan commits as they arrive, each of them once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from assayer.sources.tables import CACHE_KEY, cache_put, cache_split, table_exists


def scan_batch(batch: DataFrame, cache_path: str, scan: Callable[[DataFrame], DataFrame]) -> None:
    """Scan and cache the requests of one batch that the cache does not have."""
    spark = batch.sparkSession
    wanted = batch.select(*CACHE_KEY).dropDuplicates(CACHE_KEY)
    if table_exists(spark, cache_path):
        _, wanted = cache_split(wanted, spark.read.parquet(cache_path))
    cache_put(spark, cache_path, scan(wanted))


def _marked(spark: SparkSession, path: str, make: bool = False) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if make:
        system.create(at, True).close()
    return system.exists(at)


def scan_batch_once(
    batch: DataFrame, number: int, cache_path: str, ledger: str, scan: Callable[[DataFrame], DataFrame],
    source: str = "commits",
) -> None:
    """``scan_batch`` with a ledger: what batch ``number`` of ``source`` scanned is staged before it is put.

    A batch killed while it scans is scanned again; one killed after that is put from what it has
    staged, and one that was put is passed over.  Putting is insert-if-absent, so half a put is made whole.
    """
    spark = batch.sparkSession
    staged = f"{ledger}/{source}/batch={number}"
    if _marked(spark, f"{staged}/_PUT"):
        return
    if not _marked(spark, f"{staged}/_SUCCESS"):
        wanted = batch.select(*CACHE_KEY).dropDuplicates(CACHE_KEY)
        if table_exists(spark, cache_path):
            _, wanted = cache_split(wanted, spark.read.parquet(cache_path))
        # the writer's mark of success comes last
        scan(wanted).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(staged)
    cache_put(spark, cache_path, spark.read.parquet(staged))
    _marked(spark, f"{staged}/_PUT", make=True)


def scan_commits_once(
    requests: DataFrame, cache_path: str, ledger: str, scan: Callable[[DataFrame], DataFrame], source: str = "commits"
) -> DataStreamWriter:
    """``scan_new_commits`` with a ledger of batches beside the cache."""
    return requests.writeStream.foreachBatch(
        lambda batch, number: scan_batch_once(batch, number, cache_path, ledger, scan, source)
    )


def scan_new_commits(
    requests: DataFrame, cache_path: str, scan: Callable[[DataFrame], DataFrame]
) -> DataStreamWriter:
    """Requests not in the cache are scanned and cached; replays find their own entries.

    ``scan`` maps request rows to rows with the cache key and a ``payload``.
    """

    return requests.writeStream.foreachBatch(lambda batch, _: scan_batch(batch, cache_path, scan))
