"""Stored intermediate tables, row keys and size-checked broadcasts of the operators here."""

from __future__ import annotations

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.session import shared_dir

ROW = "_llm_row"
#: A table of at most so many short rows may be broadcast (about 40 MB as a hash table).
BROADCAST_ROWS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: it outlives executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """A 64-bit key of a document's row. Rows alike in id and text share it, and their results."""
    return F.xxhash64(F.col("doc_id"), F.col("text")).alias(ROW)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that it is no column of the documents (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def if_small(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table after counting it; beyond ``limit`` rows Spark shuffles both sides."""
    return F.broadcast(stored) if stored.limit(limit + 1).count() <= limit else stored


def ship(spark: SparkSession, model) -> Broadcast:
    """Broadcast a bounded model with its class, which the executors need not have; see ``unpack``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def unpack(sent: Broadcast):
    return cloudpickle.loads(sent.value)
