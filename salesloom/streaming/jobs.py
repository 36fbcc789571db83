"""The batch jobs run incrementally. Every sink is a table in a shared folder, none the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from salesloom.operators.upsert import changed_only
from salesloom.session import materialize, shared_dir
from salesloom.sources.files import text_schema, with_lineage


def stream_parts(spark: SparkSession, root: str, entity: str, columns: Sequence[str], files_per_batch: int = 1000) -> DataFrame:
    """New part and snapshot files of an entity as they arrive, with their lineage."""
    return with_lineage(
        spark.readStream.schema(text_schema(columns))
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(f"{root.rstrip('/')}/{entity}"),
        sequence=False,
    ).na.fill("", list(columns))


def run_available(stream: DataFrame, checkpoint: str, each) -> None:
    """Process what is there and stop; ``each(batch, batch_id)`` must be repeatable for one id."""
    query: StreamingQuery = (
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    )
    query.awaitTermination()


def write_version(table: DataFrame, target: str, batch_id: int) -> None:
    """The whole table as of a batch, in a folder of its own; a repeated batch replaces it."""
    table.write.mode("overwrite").parquet(f"{target}/version={batch_id}")


def current(spark: SparkSession, target: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """The newest version of a table (or the newest ``before`` a batch); empty where there is none. Older ones may be deleted."""
    empty = spark.createDataFrame([], schema)
    try:
        rows = spark.read.schema(StructType([*empty.schema, StructField("version", LongType())])).parquet(target)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
    known = rows if before is None else rows.where(F.col("version") < before)
    newest = known.agg(F.max("version")).first()[0]  # by the folder names
    return empty if newest is None else rows.where(F.col("version") == newest).drop("version")


def run_complete(result: DataFrame, checkpoint: str, target: str) -> None:
    """Keep the result of a streaming aggregation up to date; Spark's state holds it, a batch writes it whole."""
    query: StreamingQuery = (
        result.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda table, i: write_version(table, target, i)).start()
    )
    query.awaitTermination()


def stream_ingest(stream: DataFrame, checkpoint: str, target: str) -> None:
    """Append only the files not seen before; a repeated batch replaces its own folder."""
    run_available(stream, checkpoint, lambda batch, i: batch.write.mode("overwrite").parquet(f"{target}/batch={i}"))


def stream_upsert(stream: DataFrame, checkpoint: str, target: str, keys: Sequence[str], hash_col: str = "md_hash", order: Sequence[str] = ()) -> None:
    """Merge each batch of documents or chunks into the table; a batch without a new hash writes nothing.

    Of several rows of a key in one batch the last by ``order`` is taken, or the greatest row.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        row = F.struct(*batch.columns)
        last = F.max_by(row, F.struct(*order, *batch.columns)).alias("_row")
        once = batch.groupBy(*keys).agg(last).select("_row.*")
        stored = current(batch.sparkSession, target, batch.schema, batch_id)
        changed = materialize(changed_only(stored, once, keys, hash_col).select(*batch.columns), "changed")
        if not changed.isEmpty():
            write_version(stored.join(changed, list(keys), "left_anti").unionByName(changed), target, batch_id)

    run_available(stream, checkpoint, each)


def newest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, batch or stream; rows are combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def stream_latest(stream: DataFrame, checkpoint: str, target: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Keep the newest row per key over all batches; an older snapshot that comes late changes nothing."""
    run_complete(newest_rows(stream, keys, order), checkpoint, target)


def hourly_counts(events: DataFrame, ts: str, kind: str, value: str) -> DataFrame:
    """Count and sum per type and one-hour window; the time column must be a zoned timestamp."""
    return (
        events.groupBy(F.window(ts, "1 hour"), kind)
        .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("hour"), kind, "events", "total")
    )


def stream_hourly_counts(events: DataFrame, ts: str, kind: str, value: str, checkpoint: str, target: str) -> None:
    """Keep the hourly table up to date. Without a watermark no row is too late: its window is still in the state."""
    run_complete(hourly_counts(events, ts, kind, value), checkpoint, target)


def stream_enrich(stream: DataFrame, deals: DataFrame) -> DataFrame:
    """Activity stream with the account of its deal from a static table of unique deals."""
    return (
        stream.join(deals.select("deal_id", F.col("account_id").alias("_link")), "deal_id", "left")
        .withColumn("account_id", F.coalesce(F.col("_link").cast("string"), F.lit("")))
        .drop("_link")
    )


def folder_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int | None = 1) -> DataFrame:
    """Parquet files below a folder as they arrive; without ``files_per_batch`` all new ones are one batch."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, a file or a folder of files, as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern: a plain path must be a folder


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """A checkpoint and a target folder for one run of a named stream."""
    root = shared_dir(spark, name)
    return f"{root}/checkpoint", f"{root}/table"
