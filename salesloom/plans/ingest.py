"""Scans, snapshots, paging, dedup and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.functions.chunks import chunk_document
from salesloom.functions.text import content_hash
from salesloom.functions.values import typed_to_text
from salesloom.operators.ordered import one_page, paged_scan
from salesloom.operators.rows import dedup_keep_last, entity_project, latest_snapshot, union_parts
from salesloom.operators.upsert import (
    changed_only,
    merge_rows,
    uniqueness_check,
    upsert_actions,
    upsert_outcome,
    upsert_report,
)
from salesloom.plans.registry import query
from salesloom.session import shared_dir
from salesloom.sources.files import (
    discover_entities,
    load_entities,
    missing_columns,
    rename,
    sanitize_name,
    scan_header_csv,
    scan_infer_csv,
    scan_manifest_csv,
    scan_report,
    strip_brackets,
    write_table_overwrite,
)

ACCOUNT_COLUMNS = ["account_id", "account_name", "industry", "city", "province"]
ACCOUNT_TEXT_SQL = """
SELECT CAST(account_id AS VARCHAR) AS account_id, account_name, industry, city, province FROM account"""


def _export(r, entity: str, df, header: bool) -> str:
    """Write a role as part files below the shared folder, the way the scans expect to find it."""
    root = shared_dir(r.spark, "parts")
    df.write.option("header", header).csv(f"{root}/{entity}")
    return root


@query("scan_manifest_csv", ACCOUNT_TEXT_SQL)
def _(r):
    root = _export(r, "Dim_Account", r.account.select(*ACCOUNT_COLUMNS), header=False)
    return scan_manifest_csv(r.spark, root, "Dim_Account", ACCOUNT_COLUMNS)


@query("scan_header_csv", ACCOUNT_TEXT_SQL)
def _(r):
    root = _export(r, "Dim_Account", r.account.select(*ACCOUNT_COLUMNS), header=True)
    return scan_header_csv(r.spark, root, "Dim_Account", ACCOUNT_COLUMNS)


@query(
    "load_entities",
    """
SELECT 'Dim_Account' AS entity, count(*) AS loaded FROM account
UNION ALL SELECT 'Dim_Contact', count(*) FROM contact""",
)
def _(r):
    contact = r.contact.select("contact_id", "account_id", "contact_name")
    root = shared_dir(r.spark, "parts")
    r.account.select(*ACCOUNT_COLUMNS).write.csv(f"{root}/Dim_Account")
    contact.write.csv(f"{root}/Dim_Contact")
    manifest = {"Dim_Account": ACCOUNT_COLUMNS, "Dim_Contact": contact.columns, "Dim_Review": ["review_id"]}
    loaded = load_entities(r.spark, root, manifest, only=["Dim_Account", "Dim_Contact"])
    return union_parts(*[df.agg(F.lit(e).alias("entity"), F.count(F.lit(1)).alias("loaded")) for e, df in loaded.items()])


@query("file_lineage", "SELECT 'events.parquet' AS file_name, count(*) AS row_count FROM events")
def _(r):
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return r.table("events").select(name.alias("file_name")).groupBy("file_name").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "latest_snapshot",
    """
SELECT event_id, event_type, day FROM (
  SELECT event_id, event_type, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (PARTITION BY event_type) AS newest FROM events
) WHERE day = newest""",
)
def _(r):
    parts = r.table("events").select("event_id", "event_type", F.col("ts").cast("date").alias("day"))
    return latest_snapshot(parts, "event_type", "day").select("event_id", "event_type", "day")


@query(
    "entity_project",
    "SELECT c_custkey AS account_id, c_name AS company_name, c_mktsegment AS industry, '' AS website FROM customer",
)
def _(r):
    mapping = {"account_id": "c_custkey", "company_name": "c_name", "industry": "c_mktsegment", "website": "c_website"}
    return entity_project(r.table("customer"), mapping)


@query(
    "source_filter",
    "SELECT event_id AS activity_id, user_id AS deal_id FROM events WHERE user_id IS NOT NULL AND event_type = 'purchase'",
)
def _(r):
    return entity_project(
        r.table("events"),
        {"activity_id": "event_id", "deal_id": "user_id"},
        F.col("user_id").isNotNull() & (F.col("event_type") == "purchase"),
    )


@query(
    "paged_scan",
    """
SELECT o_orderkey, row_index, row_index // 1000 AS page FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders)""",
)
def _(r):
    paged = paged_scan(r.table("orders").select("o_orderkey"), "o_orderkey", page_size=1000)
    return paged.select("o_orderkey", F.col("row_index").cast("bigint").alias("row_index"), F.col("page").cast("bigint").alias("page"))


@query(
    "paged_scan_text",
    """
SELECT c_name, row_index, row_index // 500 AS page FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS row_index FROM customer)""",
)
def _(r):
    """Pages by a text key."""
    paged = paged_scan(r.table("customer").select("c_name"), "c_name", page_size=500)
    return paged.select("c_name", F.col("row_index").cast("bigint").alias("row_index"), F.col("page").cast("bigint").alias("page"))


@query("one_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def _(r):
    return one_page(r.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 1000)


@query("missing_columns", "SELECT '' AS website, o_orderkey, '' AS notes FROM orders")
def _(r):
    return missing_columns(r.table("orders"), ["website", "o_orderkey", "notes"])


@query(
    "typed_to_text",
    """
SELECT o_orderkey AS id,
       CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS price,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS won
FROM orders""",
)
def _(r):
    return r.table("orders").select(
        F.col("o_orderkey").alias("id"),
        typed_to_text(F.col("o_totalprice"), "double").alias("price"),
        typed_to_text(F.col("o_orderstatus") == "F", "boolean").alias("won"),
    )


@query(
    "union_parts",
    """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def _(r):
    a = r.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = r.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return union_parts(a, b)


@query(
    "dedup_keep_last",
    """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(r):
    newest = dedup_keep_last(r.table("events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return newest.select("user_id", "event_id", "event_type", "value")


# The stored state of the documents: good ones as they are, others with an older text, the rest not stored.
STORED_SQL = """
  SELECT doc_id, substr(sha256(CASE WHEN quality = 1 THEN text ELSE 'old ' || text END), 1, 16) AS md_hash
  FROM documents JOIN labels USING (doc_id)"""
FRESH_SQL = "  SELECT doc_id, source, substr(sha256(text), 1, 16) AS md_hash FROM documents"
OUTCOME_SQL = """
  SELECT f.doc_id, f.source, f.md_hash, CASE WHEN s.md_hash = f.md_hash THEN 'skipped' ELSE 'uploaded' END AS outcome
  FROM fresh f LEFT JOIN stored s USING (doc_id)"""
UPSERT = {"stored": STORED_SQL, "fresh": FRESH_SQL, "outcome": OUTCOME_SQL}


def _fresh(r):
    return r.table("documents").select("doc_id", "source", content_hash(F.col("text"), 16).alias("md_hash"))


def _stored(r):
    text = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("old "), F.col("text")))
    labelled = r.table("documents").join(r.table("labels").select("doc_id", "quality"), "doc_id")
    return labelled.select("doc_id", "source", content_hash(text, 16).alias("md_hash"))


@query("doc_upsert", "SELECT doc_id, md_hash, outcome FROM outcome", **UPSERT)
def _(r):
    return upsert_outcome(_stored(r), _fresh(r), ["doc_id"]).select("doc_id", "md_hash", "outcome")


@query(
    "doc_merge",
    "SELECT doc_id, source, md_hash FROM fresh",
    **UPSERT,
)
def _(r):
    return merge_rows(_stored(r), _fresh(r), ["doc_id"]).select("doc_id", "source", "md_hash")


@query(
    "upsert_report",
    """
SELECT source, count(*) FILTER (outcome = 'uploaded') AS uploaded, count(*) FILTER (outcome = 'skipped') AS skipped,
       count(*) FILTER (outcome = 'errors') AS errors
FROM outcome GROUP BY source""",
    **UPSERT,
)
def _(r):
    return upsert_report(upsert_outcome(_stored(r), _fresh(r), ["doc_id"]), ["source"])


@query("count_by_outcome", "SELECT outcome, count(*) AS documents FROM outcome GROUP BY outcome", **UPSERT)
def _(r):
    outcomes = upsert_outcome(_stored(r), _fresh(r), ["doc_id"])
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "changed_only",
    "SELECT doc_id, md_hash FROM outcome WHERE outcome = 'uploaded'",
    **UPSERT,
)
def _(r):
    return changed_only(_stored(r), _fresh(r), ["doc_id"]).select("doc_id", "md_hash")


# Chunks are lines here: a stored chunk lost its last line, so keys appear, change and go stale.
LINES_SQL = """
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_seq, sha256(unnest(string_split(text, chr(10)))) AS md_hash
  FROM documents"""
OLD_LINES_SQL = """
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS chunk_seq, sha256(unnest(string_split(text, chr(10)))) AS md_hash
  FROM documents JOIN labels USING (doc_id)"""


def _lines(df, shift: int):
    lines = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    return df.select("doc_id", lines).select(
        "doc_id", (F.col("pos") + shift).cast("bigint").alias("chunk_seq"), content_hash(F.col("line")).alias("md_hash")
    )


@query(
    "chunk_upsert",
    """
SELECT doc_id, CAST(chunk_seq AS BIGINT) AS chunk_seq,
       CASE WHEN o.md_hash IS NULL THEN 'insert' WHEN n.md_hash IS NULL THEN 'delete'
            WHEN o.md_hash IS DISTINCT FROM n.md_hash THEN 'update' ELSE 'keep' END AS action
FROM old_lines o FULL JOIN new_lines n USING (doc_id, chunk_seq)""",
    old_lines=OLD_LINES_SQL,
    new_lines=LINES_SQL,
)
def _(r):
    documents = r.table("documents").select("doc_id", "text")
    labelled = documents.join(r.table("labels").select("doc_id"), "doc_id", "left_semi")
    actions = upsert_actions(_lines(labelled, 1), _lines(documents, 0), ["doc_id", "chunk_seq"], stale_within="doc_id")
    return actions.select("doc_id", "chunk_seq", "action")


@query(
    "uniqueness_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(r):
    return uniqueness_check(r.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("chunk_written", None)
def _(r):
    """Rows a first load of all document chunks writes, per language."""
    documents = r.table("documents")
    chunks = chunk_document(documents, "doc_id", "text").join(documents.select("doc_id", "lang"), "doc_id")
    return chunks.groupBy("lang").agg(F.count(F.lit(1)).alias("written"), F.countDistinct("md_hash").alias("distinct_chunks"))


@query(
    "scan_infer_csv",
    "SELECT CAST(o_orderkey AS INTEGER) AS deal_id, o_totalprice AS plan_amount, CAST(o_orderdate AS DATE) AS created FROM orders",
)
def _(r):
    deals = r.table("orders").select(
        F.col("o_orderkey").alias("deal id"), F.col("o_totalprice").alias("plan (amount)"), F.col("o_orderdate").cast("date").alias("created")
    )
    rows, _ = scan_infer_csv(r.spark, _export(r, "Dim_Deal", deals, header=True), "Dim_Deal")
    return rows.toDF("deal_id", "plan_amount", "created")


@query("discover_entities", "SELECT 'Dim_Account' AS entity UNION ALL SELECT 'Dim_Contact'")
def _(r):
    root = shared_dir(r.spark, "parts")
    r.account.select("account_id").write.csv(f"{root}/Dim_Account")
    r.contact.select("contact_id").write.csv(f"{root}/Dim_Contact")
    r.activity.select("activity_id").write.csv(f"{root}/Fact_Activity")
    return discover_entities(r.spark, root)


@query("bad_part_skip", "SELECT CAST(activity_id AS VARCHAR) AS activity_id, activity_type, '' AS state FROM activity")
def _(r):
    """Lines shorter than the manifest says still load, what they lack is empty."""
    root = _export(r, "Fact_Activity", r.activity.select("activity_id", "activity_type"), header=False)
    return scan_manifest_csv(r.spark, root, "Fact_Activity", ["activity_id", "activity_type", "state"])


def _raw_part(r, root: str, folder: str, lines) -> None:
    """Lines as one part file, as they are."""
    lines.coalesce(1).write.option("sep", "\u0001").option("quote", "").csv(f"{root}/{folder}")


def _account_lines(r):
    cells = [F.col(c).cast("string") for c in ACCOUNT_COLUMNS]
    return r.account.select("account_id", F.concat_ws(",", *cells).alias("line"))


def _damaged_parts(r) -> str:
    """Three parts of one entity: one whole, one that ends inside its last row, one of a header alone."""
    root, header = shared_dir(r.spark, "parts"), ",".join(ACCOUNT_COLUMNS)
    lines = _account_lines(r)
    last = lines.agg(F.max("account_id").alias("last")).scalar()
    cut = F.when(F.col("account_id") == last, F.substring_index("line", ",", 2)).otherwise(F.col("line"))
    for folder, line in (("whole", F.col("line")), ("cut", cut)):
        rows = lines.select(F.lit(1).alias("o"), "account_id", line.alias("line"))
        top = r.spark.range(1).select(F.lit(0).alias("o"), F.lit(0).cast("long").alias("account_id"), F.lit(header).alias("line"))
        _raw_part(r, root, f"Dim_Account/{folder}", rows.unionByName(top).repartition(1).sortWithinPartitions("o", "account_id").select("line"))
    _raw_part(r, root, "Dim_Account/bare", r.spark.range(1).select(F.lit(header).alias("line")))
    return root


@query(
    "scan_damaged_parts",
    """
SELECT CAST(account_id AS VARCHAR) AS account_id, account_name, industry, city, province FROM account
UNION ALL SELECT CAST(account_id AS VARCHAR), account_name, CASE WHEN l THEN '' ELSE industry END, CASE WHEN l THEN '' ELSE city END, CASE WHEN l THEN '' ELSE province END
FROM (SELECT *, account_id = max(account_id) OVER () AS l FROM account)""",
)
def _(r):
    """All rows of a whole and of a cut-off part; the cut row as far as it goes."""
    return scan_header_csv(r.spark, _damaged_parts(r), "Dim_Account", ACCOUNT_COLUMNS)


@query(
    "scan_report",
    """
SELECT 'whole' AS folder, count(*) AS rows, CAST(0 AS BIGINT) AS malformed, 'OK' AS outcome FROM account
UNION ALL SELECT 'cut', count(*), CAST(1 AS BIGINT), 'MALFORMED' FROM account
UNION ALL SELECT 'bare', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'ZERO_ROWS'""",
)
def _(r):
    report = scan_report(r.spark, _damaged_parts(r), "Dim_Account")
    return report.select(F.regexp_extract("path", "/Dim_Account/([^/]+)/", 1).alias("folder"), "rows", "malformed", "outcome")


@query("scan_swapped_headers", ACCOUNT_TEXT_SQL)
def _(r):
    """Parts whose headers differ in order and in the columns they have; cells go by name."""
    root = shared_dir(r.spark, "parts")
    for n, columns in enumerate((ACCOUNT_COLUMNS, ACCOUNT_COLUMNS[::-1], [*ACCOUNT_COLUMNS[2:], *ACCOUNT_COLUMNS[:2]])):
        r.account.where(F.col("account_id") % 3 == n).select(*columns).write.option("header", True).csv(f"{root}/Dim_Account/{n}")
    return scan_header_csv(r.spark, root, "Dim_Account", ACCOUNT_COLUMNS)


@query("infer_outcomes", "SELECT 'Dim_Bare' AS entity, 'ZERO_ROWS' AS outcome UNION ALL SELECT 'Dim_Deal', count(*)::VARCHAR FROM orders UNION ALL SELECT 'Dim_None', 'READ_FAIL: no parts below Dim_None'")
def _(r):
    """What an ingest says of an entity with rows, of one with a header alone and of one that is not there."""
    deals = r.table("orders").select(F.col("o_orderkey").alias("deal id"), "o_totalprice")
    root = _export(r, "Dim_Deal", deals, header=True)
    _raw_part(r, root, "Dim_Bare", r.spark.range(1).select(F.lit("a,b").alias("line")))
    outcomes = [(e, scan_infer_csv(r.spark, root, e)[1]) for e in ("Dim_Bare", "Dim_Deal", "Dim_None")]
    return r.spark.createDataFrame(outcomes, "entity string, outcome string")


@query("sanitize_name", 'SELECT c_custkey AS "Account_ID", c_acctbal AS "Balance__THB_" FROM customer')
def _(r):
    named = r.table("customer").select(F.col("c_custkey").alias("Account ID"), F.col("c_acctbal").alias("Balance (THB)"))
    return rename(named, sanitize_name)


@query("strip_brackets", "SELECT c_custkey AS account_id, c_name AS company FROM customer")
def _(r):
    named = r.table("customer").select(F.col("c_custkey").alias("[account_id]"), F.col("c_name").alias("[company]"))
    return rename(named, strip_brackets)


@query("write_table_overwrite", "SELECT account_id, industry FROM account")
def _(r):
    """Written twice with different columns; the second write replaces rows and schema."""
    path = shared_dir(r.spark, "table")
    write_table_overwrite(r.account.select("account_id"), "Dim_Account_Copy", path=path)
    name = write_table_overwrite(r.account.select("account_id", "industry"), "Dim_Account_Copy", path=path)
    return r.spark.table(name)
