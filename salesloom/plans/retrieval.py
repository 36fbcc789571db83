"""Retrieval for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from salesloom.operators.retrieve import (
    build_context,
    context_blocks,
    context_budget,
    hybrid_search,
    keyword_score,
    knn_approx,
    knn_cosine,
    knn_filtered,
    merge_hits,
    score_fallback,
)
from salesloom.plans.registry import query
from salesloom.plans.shapes import whole

# ---- Inputs ----------------------------------------------------------------------------


def vectors(r, ident: str):
    """Every stored vector, as queries or as corpus."""
    return r.table("embeddings").select(
        F.col("vec_id").alias(ident), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("account_id")
    )


def questions(r):
    return r.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


def texts(r):
    return r.table("documents").select(F.col("doc_id").alias("item_id"), "text")


def hybrid_inputs(r):
    """All questions and documents, each with its vector where one is stored."""
    store = r.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = questions(r).join(store.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    stored = texts(r).join(store.withColumnRenamed("vec_id", "item_id"), "item_id", "left")
    return asked, stored


# ---- The same in SQL -------------------------------------------------------------------


def ranked_sql(source: str, k: int) -> str:
    return f"""
  SELECT query_id, item_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {source}) WHERE rank <= {k}"""


def ranked_whole_sql(source: str) -> str:
    return f"  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {source}"


COSINE_SQL = """
  SELECT q.vec_id AS query_id, c.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings c"""


def bm25_sql(asked: str, stored: str) -> dict[str, str]:
    return {
        "asked_term": f"  SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {asked}",
        "stored_term": f"  SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {stored}",
        "term_count": "  SELECT item_id, term, count(*) AS tf FROM stored_term WHERE term IN (SELECT term FROM asked_term) GROUP BY 1, 2",
        "term_docs": "  SELECT term, count(*) AS df FROM term_count GROUP BY 1",
        "item_len": f"  SELECT item_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS dl FROM {stored}",
        "corpus_stat": "  SELECT count(*) AS n, avg(dl) AS avgdl FROM item_len",
        "bm25": """
  SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked_term JOIN term_docs USING (term) JOIN term_count USING (term) JOIN item_len USING (item_id) CROSS JOIN (FROM corpus_stat) GROUP BY 1, 2""",
    }


ASKED = {"asked": "  SELECT item_id AS query_id, text FROM benchmark"}
TEXTS = {"stored": "  SELECT doc_id AS item_id, text FROM documents"}
KEYWORD = {**ASKED, **TEXTS, **bm25_sql("asked", "stored")}


@query("knn_cosine", ranked_sql("cosine", 5), cosine=COSINE_SQL)
def _(r):
    hits = knn_cosine(vectors(r, "query_id"), vectors(r, "item_id"), 5)
    return hits.select("query_id", "item_id", "score", whole("rank", "rank"))


LISTED_SQL = "SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS account_id FROM supplier WHERE s_acctbal < 0"


@query(
    "knn_filtered",
    ranked_sql("cosine", 5),
    cosine=COSINE_SQL + f" WHERE CAST(c.label AS VARCHAR) IN (SELECT account_id FROM ({LISTED_SQL}))",
)
def _(r):
    listed = r.table("supplier").where("s_acctbal < 0").select(F.col("s_nationkey").cast("string").alias("account_id"))
    hits = knn_filtered(vectors(r, "query_id"), vectors(r, "item_id"), listed, 5)
    return hits.select("query_id", "item_id", "score", whole("rank", "rank"))


@query("knn_approx")
def _(r):
    hits = knn_approx(vectors(r, "query_id"), vectors(r, "item_id"), 5)
    return hits.select("query_id", "item_id", "score", whole("rank", "rank"))


@query(
    "knn_approx_recall",
    "SELECT count(*) AS queries, 5 * count(*) AS hits, CAST(0 AS BIGINT) AS wrong_scores, CAST(0 AS BIGINT) AS misplaced, true AS recall_reached FROM embeddings",
)
def _(r):
    """The approximate hits held against the exact search over all vectors: nine in ten are found, with their exact scores."""
    asked, stored = vectors(r, "query_id"), vectors(r, "item_id")
    near = knn_approx(asked, stored, 5).select("query_id", "item_id", "score", "rank")
    exact = knn_cosine(asked, stored, 5).select("query_id", "item_id", F.col("score").alias("exact"), F.col("rank").alias("exact_rank"))
    both = near.join(exact, ["query_id", "item_id"], "full")
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        F.count("rank").alias("hits"),
        F.count_if(F.col("exact").isNotNull() & (F.col("score") != F.col("exact"))).alias("wrong_scores"),
        F.count_if(F.col("rank") > F.col("exact_rank")).alias("misplaced"),  # what is missing can only move others up
        (F.count_if(F.col("rank").isNotNull() & F.col("exact").isNotNull()) >= 0.9 * F.count("exact")).alias("recall_reached"),
    )


@query("keyword_score", ranked_sql("bm25", 5), **KEYWORD)
def _(r):
    hits = keyword_score(questions(r), texts(r), 5)
    return hits.select("query_id", "item_id", "score", whole("rank", "rank"))


HYBRID = {
    "asked": "  SELECT item_id AS query_id, text, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id",
    "stored": "  SELECT doc_id AS item_id, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    **bm25_sql("asked", "stored"),
    "cosine": """
  SELECT q.query_id, c.item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM asked q CROSS JOIN (FROM stored) c WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL""",
    "vector_leg": ranked_whole_sql("cosine"),
    "word_leg": ranked_whole_sql("bm25"),
    "fused": """
  SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score
  FROM (SELECT * FROM vector_leg UNION ALL SELECT * FROM word_leg) GROUP BY 1, 2""",
}


@query("hybrid_search", ranked_sql("fused", 5), **HYBRID)
@query("hybrid_search_whole", ranked_sql("fused", 5), **HYBRID)
def _(r):
    hits = hybrid_search(*hybrid_inputs(r), 5)
    return hits.select("query_id", "item_id", "score", whole("rank", "rank"))


@query(
    "score_fallback",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_tax + 0.0, 0), l_discount, 0) + 0.0 AS score FROM lineitem""",
)
def _(r):
    score = score_fallback(F.col("l_tax") + F.lit(0.0), F.col("l_discount")) + F.lit(0.0)
    return r.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))


# ---- Merge, rank, pack -----------------------------------------------------------------


def two_lists(r):
    """Hits of both retrievers over the same documents, with their text."""
    asked, stored = hybrid_inputs(r)
    content = texts(r).withColumnRenamed("text", "content")

    def with_text(hits):
        return hits.join(content, "item_id").select("query_id", "item_id", "content", "score", "rank")

    near = knn_cosine(asked.where("vector IS NOT NULL"), stored.where("vector IS NOT NULL"), 5)
    return with_text(near), with_text(keyword_score(asked, stored, 5))


def merged_sql(score: str = "score") -> dict[str, str]:
    return {
        **HYBRID,
        "first_list": ranked_sql("cosine", 5),
        "second_list": ranked_sql("bm25", 5),
        "both_lists": """
  SELECT h.*, d.text AS content, trim(d.text) AS same FROM (
    SELECT *, 1 AS source FROM first_list UNION ALL SELECT *, 2 AS source FROM second_list) h JOIN documents d ON d.doc_id = h.item_id""",
        "voted": "  SELECT *, round(sum(1.0::DOUBLE / (60 + rank)) OVER (PARTITION BY query_id, same), 6) AS vote FROM both_lists WHERE same <> ''",
        "unique_hit": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, same ORDER BY source, rank) AS rn FROM voted) WHERE rn = 1""",
        "merged": f"""
  SELECT query_id, item_id, content, source, rank AS old_rank, {score} AS score, merged_rank AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, source, rank) AS merged_rank FROM unique_hit) WHERE merged_rank <= 8""",
    }


RAW, RRF = merged_sql(), merged_sql("vote")


@query("merge_hits", "SELECT query_id, item_id, score, CAST(source AS BIGINT) AS source, rank FROM merged", **RAW)
def _(r):
    merged = merge_hits(*two_lists(r), 8)
    return merged.select("query_id", "item_id", "score", whole("source", "source"), whole("merged_rank", "rank"))


@query("merge_topk", "SELECT query_id, item_id, score, rank FROM merged", **RRF)
def _(r):
    """The recommended merge: reciprocal ranks instead of raw scores of different scales."""
    merged = merge_hits(*two_lists(r), 8, mode="rrf")
    return merged.select("query_id", "item_id", "score", whole("merged_rank", "rank"))


@query(
    "dedup_keep_first",
    """
SELECT lang, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, trim(text) ORDER BY source, doc_id) AS rn
  FROM documents WHERE trim(text) <> '') WHERE rn = 1""",
)
def _(r):
    window = Window.partitionBy("lang", "_same").orderBy("source", "doc_id")
    rows = r.table("documents").where(F.trim("text") != "").select("lang", "doc_id", "source", F.sha2(F.trim("text"), 256).alias("_same"))
    return rows.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").select("lang", "doc_id")


@query("rank_as_seq", "SELECT query_id, item_id, rank - 1 AS chunk_seq FROM (" + ranked_sql("bm25", 5) + ")", **KEYWORD)
def _(r):
    hits = keyword_score(questions(r), texts(r), 5)
    return hits.select("query_id", "item_id", whole(F.col("rank") - 1, "chunk_seq"))


@query(
    "retrieve_merge",
    """
SELECT query_id, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS sources, count(*) FILTER (source = 1) AS vector_hits, count(*) FILTER (source = 2) AS keyword_hits
FROM merged GROUP BY query_id""",
    **RAW,
)
def _(r):
    """Per question the cited items and how many came from each retriever (at most k per question)."""
    merged = merge_hits(*two_lists(r), 8)
    cited = F.transform(F.sort_array(F.collect_list(F.struct("merged_rank", "item_id"))), lambda x: x["item_id"].cast("string"))
    return merged.groupBy("query_id").agg(
        F.array_join(cited, ",").alias("sources"),
        F.count_if(F.col("source") == 1).alias("vector_hits"),
        F.count_if(F.col("source") == 2).alias("keyword_hits"),
    )


def merged_context(r):
    merged = merge_hits(*two_lists(r), 8)
    return merged.select("query_id", F.col("merged_rank").alias("rank"), F.col("item_id").alias("account_id"), "content", "score")


BLOCK_SQL = """
  SELECT query_id, rank, '[' || rank || '] Account: ' || {label} || ' (similarity: ' || printf('%.3f', score) || ')' || chr(10) ||
         trim(content) || chr(10) AS block FROM merged {join}"""
PACKED_SQL = """
  SELECT query_id, rank, CASE WHEN used + length(block) <= 8000 THEN block ELSE left(block, 8000 - used) || chr(10) || '[truncated]' END AS text,
         used + length(block) > 8000 AS truncated
  FROM (SELECT *, CAST(coalesce(sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM block)
  WHERE used + length(block) <= 8000 OR 8000 - used > 100"""


@query(
    "context_budget",
    "SELECT query_id, CAST(rank AS BIGINT) AS rank, text, truncated FROM packed",
    **RAW,
    block=BLOCK_SQL.format(label="item_id", join=""),
    packed=PACKED_SQL,
)
def _(r):
    packed = context_budget(context_blocks(merged_context(r)))
    return packed.select("query_id", whole("rank", "rank"), "text", "truncated")


@query(
    "build_context",
    "SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM packed GROUP BY query_id",
    **RAW,
    block=BLOCK_SQL.format(
        label="CASE WHEN account_name <> '' THEN account_name || ' (account_id ' || item_id || ')' ELSE item_id || ' (ไม่พบชื่อ)' END",
        join="LEFT JOIN account ON account_id = item_id",
    ),
    packed=PACKED_SQL,
)
def _(r):
    return build_context(merged_context(r), r.account)
