"""Tables kept between jobs: scan cache, results, vector index.

Plain parquet has no MERGE or DELETE.  Keys are hashed into a fixed number of bucket folders, so
the number of partitions does not grow with the data, and a replacement rewrites the buckets it
touches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import paths as P
from assayer.operators import runs
from assayer.session import materialize, small_side

CACHE_KEY = ["repo_id", "commit_sha", "scan_version", "config_hash", "language"]
BUCKETS = 64


def bucket_of(column: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _by_bucket(rows: DataFrame, key: str) -> DataFrame:
    """Rows with their bucket, rebalanced: few files per bucket, and a hot bucket is split."""
    return rows.withColumn("bucket", bucket_of(key)).hint("rebalance", "bucket")


def table_exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


# --- scan cache ---------------------------------------------------------------------------


def stored_keys(cache: DataFrame) -> DataFrame:
    """The keys of a cache as a join side that is sorted and may spill.

    Keys repeat most of their columns, so the files say little of how many there are: a cache that
    is broadcast on the size of its files takes many times as much memory in every task.
    """
    return cache.select(*CACHE_KEY).hint("merge")


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits with payload, misses)`` of requests on the five-column key.

    Stored payloads are wide: the keys asked for go to them, and what does not match is gone
    before anything is shuffled.
    """
    asked = small_side(requests.select(*CACHE_KEY).distinct())
    stored = cache.select(*CACHE_KEY, "payload").join(asked, CACHE_KEY, "left_semi")
    hits = requests.join(stored.dropDuplicates(CACHE_KEY), CACHE_KEY)
    misses = requests.join(stored_keys(cache), CACHE_KEY, "left_anti")
    return hits, misses


def cache_additions(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: one per new key; keys already there are left alone."""
    return new.dropDuplicates(CACHE_KEY).join(stored_keys(cache), CACHE_KEY, "left_anti")


def cache_put(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Insert if absent; inserting twice is no error and changes nothing."""
    rows = cache_additions(spark.read.parquet(path), new) if table_exists(spark, path) else new.dropDuplicates(CACHE_KEY)
    _by_bucket(rows, "repo_id").write.mode("append").partitionBy("bucket").parquet(path)


def cache_invalidate(cache: DataFrame, repo_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(remaining cache, removed count per repository)``, all languages and versions."""
    ids = repo_ids.select("repo_id").distinct()
    removed = cache.join(ids, "repo_id", "left_semi").groupBy("repo_id").agg(F.count("*").alias("removed"))
    return cache.join(ids, "repo_id", "left_anti"), removed


# --- results ------------------------------------------------------------------------------


def drop_folders(spark: SparkSession, path: str, column: str, values: list) -> None:
    """Remove partition folders that a rewrite left without rows."""
    jvm = spark.sparkContext._jvm
    for value in values:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def replace_results(
    spark: SparkSession, path: str, new: DataFrame, runs: DataFrame | None = None
) -> None:
    """Replace all results of ``runs`` by ``new``; running it again changes nothing.

    ``runs`` (``analysis_id``) names what is replaced, also runs without new rows; by default the
    runs in ``new``.  The buckets of those runs are rebuilt in the shared folder first, then
    overwritten as partitions, so a failed job leaves the old rows in place.
    """
    incoming = new.withColumn("bucket", bucket_of("analysis_id"))
    emptied: list[int] = []
    if table_exists(spark, path):
        replaced = (new if runs is None else runs).select("analysis_id")
        replaced = materialize(replaced.unionByName(new.select("analysis_id")).distinct(), "runs")
        # at most BUCKETS numbers: as literals they prune the folders that are read
        touched = [r[0] for r in replaced.select(bucket_of("analysis_id")).distinct().collect()]
        kept = (
            spark.read.parquet(path)
            .filter(F.col("bucket").isin(touched))
            .join(replaced, "analysis_id", "left_anti")
        )
        incoming = materialize(kept.unionByName(incoming), "results")
        filled = {r[0] for r in incoming.select("bucket").distinct().collect()}
        emptied = [bucket for bucket in touched if bucket not in filled]
    (
        incoming.hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )
    drop_folders(spark, path, "bucket", emptied)


# --- reservation log ----------------------------------------------------------------------


def log_append(path: str, rows: DataFrame) -> None:
    """Add rows to the stored quota log, which is kept by day of expiry, else of creation."""
    day = F.to_date(F.coalesce("expires_at", "created_at"))
    rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def sweep_log(spark: SparkSession, path: str, as_of: Column) -> int:
    """Delete expired reservations from the stored log; returns how many.

    Only the days that hold one are rewritten, so a sweep costs what it reclaims.  Sweeping
    again at the same time finds nothing.
    """
    log = spark.read.parquet(path)
    expired = runs.is_expired(as_of)
    found = log.filter(expired).groupBy("day").agg(F.count("*").alias("n")).collect()
    if not found:
        return 0
    touched = [r["day"] for r in found]
    kept = materialize(log.filter(F.col("day").isin(touched) & ~expired), "swept")
    filled = {r[0] for r in kept.select("day").distinct().collect()}
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    drop_folders(spark, path, "day", [day for day in touched if day not in filled])
    return sum(r["n"] for r in found)


# --- vector index -------------------------------------------------------------------------


def index_refs(runs: DataFrame) -> DataFrame:
    """Collections that runs point at; runs without a commit have none."""
    return (
        runs.filter(F.col("repo_sha").isNotNull())
        .select(
            P.collection_key(F.col("user_id"), F.col("repo_name"), F.col("repo_sha")).alias("collection")
        )
        .distinct()
    )


def index_exists(refs: DataFrame, index: DataFrame) -> DataFrame:
    return refs.join(index.select("collection"), "collection", "left_semi")


def index_additions(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """Vectors of collections that are not in the index yet; the others are left as they are."""
    return vectors.join(index.select("collection").distinct(), "collection", "left_anti")


def drop_index(index: DataFrame, refs: DataFrame) -> DataFrame:
    """The index without the given collections; write it as a new snapshot."""
    return index.join(refs.select("collection").distinct(), "collection", "left_anti")


def build_index(spark: SparkSession, path: str, vectors: DataFrame) -> None:
    rows = index_additions(vectors, spark.read.parquet(path)) if table_exists(spark, path) else vectors
    _by_bucket(rows, "collection").write.mode("append").partitionBy("bucket").parquet(path)
