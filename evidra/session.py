"""Session, table loading and the two physical helpers every job shares.

``materialize`` cuts lineage into the cluster's shared checkpoint folder and
``broadcast_if_small`` broadcasts a side only after its size has been measured.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 64 * 1024 * 1024
#: Bytes of an Arrow batch sent to a Python worker.
ARROW_BATCH_BYTES = 8 * 1024 * 1024


def get_session(app_name: str = "evidra", master: str | None = None) -> SparkSession:
    """Session with the settings the jobs rely on; cluster settings win when present."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Union keeps its children's hash partitioning in 4.1; after adaptive coalescing the
    children no longer line up and a following group-by splits its groups. Off until fixed.
    Batches of long texts are bounded by their bytes, not by their number alone, as a Python worker holds a whole one."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def union_all(parts: list[DataFrame]) -> DataFrame:
    prepare(parts[0].sparkSession)
    return reduce(DataFrame.unionByName, parts)


def load_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by the cluster. A private one is made only where driver and executors are one
    process; on a cluster a folder of the driver's machine would lose rows, so its lack is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="evidra-checkpoint-"))


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write an intermediate result once to a table in the shared folder and continue from it; ``compression`` names a
    Parquet codec other than the session's.

    The lineage ends there, an executor lost later costs no recomputation, and the table's
    size is known to the planner of every later job.
    """
    folder = work_folder(df.sparkSession, "stage")
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where they come from few files, which Spark may not be able to split; a table of many files stays
    where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * len(df.inputFiles()) <= cores else df


def measured_bytes(df: DataFrame) -> int:
    """Serialised size of a (small or already materialised) table, summed by Spark."""
    if not df.columns:
        return 0
    width = F.length(F.to_json(F.struct(*df.columns)))
    total = df.agg(F.sum(width).alias("b")).first()["b"]
    return int(total or 0)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint when the measured size is within the bound; otherwise leave the
    choice to Spark (shuffled join, with skew splitting by AQE)."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession, seconds: float = 1.0) -> None:
    """Lets Spark's cleaner drop shuffle files of jobs whose results are already staged; it works in the background
    after a collection of the driver's garbage, so disk use is lower when the next job writes."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(seconds / 2)
