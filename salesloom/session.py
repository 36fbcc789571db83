"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings the jobs rely on. AQE measures shuffle output before it picks a join, so the
# library carries no forced broadcast of a table: a side is broadcast only after its
# size is known, and a skewed sort-merge join is split at run time.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call site per column: plans are built faster
}


def build_session(app: str = "salesloom", cpus: int | None = None) -> SparkSession:
    """A local session when ``cpus`` is given, else whatever spark-submit configured."""
    builder = SparkSession.builder.appName(app)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    if cpus:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", os.environ.get("SALESLOOM_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder that ``spark.checkpoint.dir`` names.

    Every executor must see that folder. Where it is unset, a folder beside the warehouse's
    tables is used and set, which all executors share as well; never a machine's own temp folder.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result that several steps read to the shared folder, once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
