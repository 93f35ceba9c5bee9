"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot repositories: let AQE cut an oversized join partition, also when the
    # join feeds an aggregate on the same key.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole files travel in the Arrow batches, so few rows per batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Remembers the folder of a local session that was given none.
OWN_FOLDER = "assayer.shared.folder"
RUN = "assayer.run.folder"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan of this package assumes."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data.

    It has to be visible to every executor.  Only a local session, where driver and executors
    share one disk, may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="assayer-")
    spark.conf.set(OWN_FOLDER, folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's intermediate tables, below the shared one."""
    top = shared_folder(spark).rstrip("/")
    run = spark.conf.get(RUN, None)
    if run is None:
        run = f"run-{uuid.uuid4().hex}"
        spark.conf.set(RUN, run)
    return f"{top}/{run}"


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session.

    Call it when all results have been written: a frame that was not still reads its tables.  What
    is to last, such as an index, gets a path of its own and is not touched.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    spark.conf.unset(RUN)


def spread(df: DataFrame, limit: int = 64) -> DataFrame:
    """Share a source out that arrives in fewer splits with rows than there are cores.

    A small file of long texts is one split, hence one task.  Of a larger file only the splits where
    a row group starts have rows, and a file may be one group; they are counted from the footers.  A
    source of as many files or groups as cores passes through untouched: it is never shuffled here.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, limit)
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    if len(df.inputFiles()) >= cores:
        return df
    filled = df.select(F.spark_partition_id().alias("split")).distinct().count()
    return df if filled >= cores else df.repartition(cores)


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, compressed as said or as the session says.

    Cuts lineage for results that several branches of a plan read; unlike an in-memory cache
    it survives the loss of executors, and unlike ``checkpoint()`` it stays columnar, so
    readers still prune columns and push filters.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path, compression=compression)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path  # for discard
    return written


def gathered(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df``, known to have about ``rows`` rows, in as many tasks as these need.

    For the small tables of an iteration: what is left of a shuffle need not be as many tasks, files
    and folders as a large one has.  Only where the tasks are, never what they hold, depends on it.
    """
    return df.coalesce(max(1, -(-rows // per_task)))


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these frames, once nothing will read them any more.

    For rounds of an iteration: the next round has been written by then, so no lost executor can
    ask for the tables of the one before.  Other frames are passed over.
    """
    for frame in frames:
        path = getattr(frame, "_written_to", None)
        if path is not None:
            delete_table(frame.sparkSession, path)


def delete_table(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_side(df: DataFrame, limit: int = 500_000) -> DataFrame:
    """A narrow join side, for broadcast if it is counted to have at most ``limit`` rows.

    For joins whose other side carries contents or vectors: planned by estimate, such a join
    would shuffle the wide side before the small one is known to be small.  The side is written
    once, counted up to the limit, and joined by shuffle as usual when it is larger.
    """
    written = materialize(df, "side")
    return F.broadcast(written) if written.limit(limit + 1).count() <= limit else written
