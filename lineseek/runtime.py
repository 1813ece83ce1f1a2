"""Session settings shared by every job: parallelism, checkpoints, broadcast limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after a count has shown that it stays under this.
BROADCAST_ROWS = 400_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the cluster's own setting first.

    Only a local session without the setting gets a temporary folder; a cluster
    without one is an error, because executors would not share the files.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="lineseek-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet next to the checkpoints and read it back.

    What follows starts from stored rows: it does not change when a lost task is redone,
    reads only the columns it needs, and an executor loss costs nothing already computed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_path = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialize` stored, once nothing is read from them any more."""
    for table in tables:
        remove_path(table.sparkSession, table.stored_path)


def shuffle_parts(spark: SparkSession) -> int:
    """Parts for what is dealt out by hand: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one round-robin shuffle.

    A large table already arrives in many splits and is passed through as it is,
    so the shuffle only ever moves an input too small to have them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when at most `limit` rows exist; else leave the join to AQE."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote and no longer needs; a missing one is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
