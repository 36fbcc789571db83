"""The incremental jobs, run over the given tables until nothing is left, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.functions.text import content_hash
from salesloom.plans.registry import query
from salesloom.plans.shapes import money, sql_money
from salesloom.session import shared_dir
from salesloom.streaming import jobs


@query("stream_ingest", "SELECT event_id, user_id, event_type FROM events")
def _(r):
    checkpoint, target = jobs.stream_paths(r.spark, "ingest")
    jobs.stream_ingest(jobs.table_stream(r.spark, r.sf_dir, "events").select("event_id", "user_id", "event_type"), checkpoint, target)
    return r.spark.read.parquet(target).select("event_id", "user_id", "event_type")


@query("stream_upsert", "SELECT doc_id, sha256(text) AS md_hash FROM documents")
def _(r):
    """The documents arrive twice; the second run has new files only if there are any."""
    checkpoint, target = jobs.stream_paths(r.spark, "upsert")
    for _ in range(2):
        stream = jobs.table_stream(r.spark, r.sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("md_hash"))
        jobs.stream_upsert(stream, checkpoint, target, ["doc_id"])
    return jobs.current(r.spark, target, "doc_id bigint, md_hash string").select("doc_id", "md_hash")


@query(
    "stream_hourly_counts",
    f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, {sql_money('sum(CAST(value AS DECIMAL(12,2)))', 'total')}
FROM events GROUP BY 1, 2""",
)
def _(r):
    checkpoint, target = jobs.stream_paths(r.spark, "hourly")
    events = jobs.table_stream(r.spark, r.sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(12,2)").alias("value")
    )
    jobs.stream_hourly_counts(events, "ts", "event_type", "value", checkpoint, target)
    table = jobs.current(r.spark, target, "hour timestamp, event_type string, events bigint, total decimal(22,2)")
    return table.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", money("total", "total"))


@query(
    "stream_latest",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def _(r):
    checkpoint, target = jobs.stream_paths(r.spark, "latest")
    events = jobs.table_stream(r.spark, r.sf_dir, "events").select("user_id", "event_id", "ts", "value")
    jobs.stream_latest(events, checkpoint, target, ["user_id"], ["ts", "event_id"])
    return jobs.current(r.spark, target, events.schema).select("user_id", "event_id", "value")


@query(
    "stream_enrich",
    "SELECT event_id AS activity_id, coalesce(CAST(o_custkey AS VARCHAR), '') AS account_id FROM events LEFT JOIN orders ON user_id = o_orderkey",
)
def _(r):
    checkpoint, target = jobs.stream_paths(r.spark, "enrich")
    events = jobs.table_stream(r.spark, r.sf_dir, "events").select(F.col("event_id").alias("activity_id"), F.col("user_id").alias("deal_id"))
    jobs.stream_ingest(jobs.stream_enrich(events, r.deal_core), checkpoint, target)
    return r.spark.read.parquet(target).select("activity_id", "account_id")


# ---- Several batches: changes, repeats and late rows -----------------------------------


def _arrive(r, name: str, batches, job) -> None:
    """Each batch as the new files of a folder, as many as its tasks write, and behind each a run of the job, which takes them as one batch."""
    folder = shared_dir(r.spark, name)
    for i, batch in enumerate(batches):
        batch.write.parquet(f"{folder}/{i}")
        job(jobs.folder_stream(r.spark, folder, batch.schema, files_per_batch=None))


@query("stream_parts", "SELECT CAST(account_id AS VARCHAR) AS account_id, account_name, industry, CASE WHEN account_id % 4 = 0 THEN 'yes' ELSE '' END AS snapshot FROM account")
def _(r):
    """Part files without a header, streamed with their lineage: live parts and a snapshot folder."""
    root, columns = shared_dir(r.spark, "parts"), ["account_id", "account_name", "industry", "snapshot"]
    accounts = r.account.select("account_id", "account_name", "industry", F.when(F.col("account_id") % 4 == 0, "yes").otherwise("").alias("snapshot"))
    for n in range(2):
        accounts.where(F.col("account_id") % 2 == n).write.csv(f"{root}/Dim_Account/{n}")
    checkpoint, target = jobs.stream_paths(r.spark, "parts")
    for _ in range(2):  # the second run finds nothing new
        jobs.stream_ingest(jobs.stream_parts(r.spark, root, "Dim_Account", columns), checkpoint, target)
    return r.spark.read.parquet(target).where("_part <> ''").select(*columns)


@query(
    "stream_upsert_batches",
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text || 'third') WHEN doc_id % 2 = 0 THEN sha256(text || 'second') ELSE sha256(text) END AS md_hash FROM documents""",
)
def _(r):
    """Three batches: all documents; half of them changed and the rest again; a third changed, each row twice."""
    text = r.table("documents").select("doc_id", "text")

    def hashed(rows, tail: str = ""):
        return rows.select("doc_id", content_hash(F.concat("text", F.lit(tail))).alias("md_hash"))

    second = hashed(text.where("doc_id % 2 = 0"), "second").unionByName(hashed(text.where("doc_id % 2 = 1")))
    third = hashed(text.where("doc_id % 3 = 0"), "third")
    checkpoint, target = jobs.stream_paths(r.spark, "upserts")
    _arrive(r, "changes", [hashed(text), second, third.unionByName(third)], lambda stream: jobs.stream_upsert(stream, checkpoint, target, ["doc_id"]))
    return jobs.current(r.spark, target, "doc_id bigint, md_hash string")


def _three(r, rows):
    """Rows in three batches whose times overlap, the later ones of the first batch before the earlier ones of the last."""
    return [rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n) for n in range(3)]


@query(
    "stream_latest_batches",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def _(r):
    """The newest event per user over three batches, late and repeated rows among them."""
    events = r.table("events").select("user_id", "event_id", "ts", "value")
    first, second, third = _three(r, events)
    checkpoint, target = jobs.stream_paths(r.spark, "latest")
    batches = [first, second, third.unionByName(first)]
    _arrive(r, "events", batches, lambda stream: jobs.stream_latest(stream, checkpoint, target, ["user_id"], ["ts", "event_id"]))
    return jobs.current(r.spark, target, events.schema).select("user_id", "event_id", "value")


@query(
    "stream_hourly_batches",
    f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, {sql_money('sum(CAST(value AS DECIMAL(12,2)))', 'total')}
FROM events GROUP BY 1, 2""",
)
def _(r):
    """Hourly counts over three batches whose hours overlap."""
    events = r.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(12,2)").alias("value"))
    checkpoint, target = jobs.stream_paths(r.spark, "hourly")
    _arrive(r, "events", _three(r, events), lambda stream: jobs.stream_hourly_counts(stream, "ts", "event_type", "value", checkpoint, target))
    table = jobs.current(r.spark, target, "hour timestamp, event_type string, events bigint, total decimal(22,2)")
    return table.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", money("total", "total"))
