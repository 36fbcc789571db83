"""Documents, chunks and vectors."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from salesloom.functions.chunks import chunk_document, count_tokens, sliding_windows, split_sections
from salesloom.functions.text import collapse_space, content_hash
from salesloom.operators import docs
from salesloom.operators.retrieve import embed_batch
from salesloom.operators.upsert import upsert_outcome, upsert_report
from salesloom.plans.joins import ACTIVITIES_SQL, FLAT_SQL, account_activities, account_frames, deal_fields, deal_records, flat_deals
from salesloom.plans.registry import query
from salesloom.plans.shapes import whole
from salesloom.plans.values import strip_html_sql
from salesloom.session import materialize

NL = "chr(10)"


def account_docs(r):
    return docs.account_docs(*account_frames(r))


def corpus(r, deals=None):
    """Every document of the account corpus and the three lenses; what they share is written once."""
    deals = materialize(flat_deals(r), "deals") if deals is None else deals
    activities = materialize(account_activities(r), "activities")
    return docs.corpus_union(
        account=docs.account_docs(*account_frames(r, deal_fields(deals), activities)),
        solution=docs.solution_docs(deals),
        salesperson=docs.salesperson_docs(deals, activities.drop("account_id"), recent=50),
        industry=docs.industry_docs(r.account, deals),
    )


def _section_sql(title: str, n: str, lines: str) -> str:
    return f"'## {title} (' || coalesce({n}, 0) || ')' || {NL} || coalesce({lines}, '_(none)_' || {NL})"


ACTIVITY_LINE = f"'- **' || activity_date || '** — ' || subject || ' (' || activity_type || ') — ' || state || {NL}"
ACCOUNT_DOCS_SQL = f"""
  SELECT account_id, '---' || {NL} || 'entity: account' || {NL} || 'account_id: ' || account_id || {NL} || 'name: ' || account_name || {NL} ||
    'industry: ' || industry || {NL} || 'status: ' || account_status || {NL} || '---' || {NL} || {NL} || '# ' || account_name || {NL} || {NL} ||
    '**Customer Code:** —' || {NL} || '**Industry:** ' || industry || {NL} || '**Customer Type:** ' || customer_type || {NL} ||
    '**Account Status:** ' || account_status || {NL} || '**Annual Revenue:** —' || {NL} || '**No. of Employees:** —' || {NL} ||
    '**Location:** ' || city || ', ' || province || {NL} || '**Website:** —' || {NL} || {NL} ||
    {_section_sql('Contacts', 'c.n', 'c.t')} || {NL} || {_section_sql('Opportunities', 'd.n', 'd.t')} || {NL} ||
    {_section_sql('Recent Activities', 'v.n', 'v.t')} || coalesce({NL} || '## Notes (' || t.n || ')' || {NL} || t.t, '') AS body
  FROM account
  LEFT JOIN (SELECT account_id, count(*) AS n, string_agg('- **' || contact_name || '** — ' || job_title || {NL}, '' ORDER BY contact_id) AS t
             FROM contact GROUP BY 1) c USING (account_id)
  LEFT JOIN (SELECT account_id, count(*) AS n, string_agg('- **' || deal_name || '** — ' || status || ' | Possibility: ' || possibility || '%' || {NL} ||
               '  Est. Close: ' || est_close || ' | SO Plan: ' || plan_amount || coalesce(' | Solution: ' || solution, '') ||
               coalesce(' | Sales: ' || person, '') || {NL}, '' ORDER BY deal_id) AS t FROM deal GROUP BY 1) d USING (account_id)
  LEFT JOIN (SELECT account_id, count(*) AS n, string_agg({ACTIVITY_LINE}, '' ORDER BY activity_id) AS t FROM account_activity GROUP BY 1) v USING (account_id)
  LEFT JOIN (SELECT account_id, count(*) AS n, string_agg('**' || title || '** ()' || {NL} || {strip_html_sql('body')} || {NL} || {NL}, '' ORDER BY note_id) AS t
             FROM note WHERE trim(body) <> '' GROUP BY 1) t USING (account_id)"""
ACCOUNT = {"account_doc": ACCOUNT_DOCS_SQL, "account_activity": ACTIVITIES_SQL}


@query(
    "render_account_doc",
    "SELECT 'account/' || account_id || '.md' AS path, body, substr(sha256(body), 1, 16) AS md_hash FROM account_doc",
    **ACCOUNT,
)
def _(r):
    return account_docs(r).select("path", "body", "md_hash")


def _head_sql(kind: str, value: str) -> str:
    title = kind.capitalize()
    return f"'---' || {NL} || 'entity: {kind}' || {NL} || '{kind}: ' || {value} || {NL} || '---' || {NL} || {NL} || '# {title}: ' || {value} || {NL} || {NL}"


SOLUTION_DOCS_SQL = f"""
SELECT 'solution/' || lower(solution) || '.md' AS path, {_head_sql('solution', 'solution')} || '**Deals:** ' || count(*) || ' across ' ||
  count(DISTINCT account_name) || ' accounts' || {NL} || {NL} ||
  string_agg('- **' || account_name || '** — ' || deal_name || ' (' || status || ') | Possibility: ' || possibility || '%' ||
             coalesce(' | Sales: ' || person, '') || {NL}, '' ORDER BY deal_id) AS body
FROM flat WHERE solution IS NOT NULL GROUP BY solution"""


@query("render_solution_doc", SOLUTION_DOCS_SQL, flat=FLAT_SQL)
def _(r):
    return docs.solution_docs(flat_deals(r)).select("path", "body")


PERSON_DOCS_SQL = f"""
SELECT 'salesperson/' || replace(lower(person), '#', '-') || '.md' AS path, {_head_sql('salesperson', 'person')} || '**Accounts:** ' || accounts ||
  ' | **Deals:** ' || deals || {NL} || {NL} || '## Deals' || {NL} || lines || {NL} || {_section_sql('Recent Activities', 'n', 't')} AS body
FROM (SELECT person, count(*) AS deals, count(DISTINCT account_name) AS accounts,
        string_agg('- **' || account_name || '** — ' || deal_name || ' (' || status || ')' || coalesce(' | ' || solution, '') ||
                   ' | Est. Close: ' || est_close || {NL}, '' ORDER BY deal_id) AS lines
      FROM flat WHERE person IS NOT NULL GROUP BY 1)
LEFT JOIN (SELECT person, count(*) AS n, string_agg({ACTIVITY_LINE}, '' ORDER BY rn) AS t FROM (
        SELECT *, row_number() OVER (PARTITION BY person ORDER BY activity_date DESC, activity_id) AS rn
        FROM account_activity JOIN (SELECT deal_id, person FROM flat WHERE person IS NOT NULL) USING (deal_id)) WHERE rn <= 50 GROUP BY 1) USING (person)"""


@query("render_salesperson_doc", PERSON_DOCS_SQL, flat=FLAT_SQL, account_activity=ACTIVITIES_SQL)
def _(r):
    return docs.salesperson_docs(flat_deals(r), account_activities(r).drop("account_id"), recent=50).select("path", "body")


INDUSTRY_DOCS_SQL = f"""
SELECT 'industry/' || lower(industry) || '.md' AS path, {_head_sql('industry', 'industry')} || '**Accounts:** ' || count(*) || {NL} || {NL} ||
  string_agg('- **' || account_name || '** (' || customer_type || ') — ' || city || ', ' || province || ' | Opps: ' || coalesce(n, 0) ||
             coalesce(' | Solutions: ' || solutions, '') || {NL}, '' ORDER BY account_id) AS body
FROM account LEFT JOIN (
  SELECT account_id, count(*) AS n, string_agg(DISTINCT solution, ', ' ORDER BY solution) AS solutions FROM deal GROUP BY 1) USING (account_id)
GROUP BY industry"""


@query("render_industry_doc", INDUSTRY_DOCS_SQL)
def _(r):
    return docs.industry_docs(r.account, r.deal).select("path", "body")


@query("doc_path", "SELECT deal_id, 'solution/' || coalesce(lower(solution), 'unknown') || '.md' AS path FROM deal")
def _(r):
    return r.deal.select("deal_id", docs.doc_path("solution", F.col("solution")).alias("path"))


@query(
    "corpus_union",
    """
SELECT 'account' AS doc_type, count(*) AS documents FROM account
UNION ALL SELECT 'solution', count(DISTINCT solution) FROM deal
UNION ALL SELECT 'salesperson', count(DISTINCT person) FROM deal
UNION ALL SELECT 'industry', count(DISTINCT industry) FROM account""",
)
def _(r):
    return corpus(r).groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"))


def _hashes_sql(kind: str, source: str) -> str:
    return f"SELECT '{kind}' AS doc_type, path, substr(sha256(body), 1, 16) AS md_hash FROM {source}"


@query(
    "corpus_documents",
    "\nUNION ALL ".join(
        [
            _hashes_sql("account", "(SELECT 'account/' || account_id || '.md' AS path, body FROM account_doc)"),
            _hashes_sql("solution", "solution_doc"),
            _hashes_sql("salesperson", "person_doc"),
            _hashes_sql("industry", "industry_doc"),
        ]
    ),
    **ACCOUNT,
    flat=FLAT_SQL,
    solution_doc=SOLUTION_DOCS_SQL,
    person_doc=PERSON_DOCS_SQL,
    industry_doc=INDUSTRY_DOCS_SQL,
)
def _(r):
    """Every document of the whole corpus with the hash of its body."""
    return corpus(r).select("doc_type", "path", "md_hash")


# ---- Account documents with all three levels -------------------------------------------

DEAL_LINES_SQL = f"""
  SELECT account_id, count(*) AS n, string_agg('- **' || deal_name || '** — ' || status || ' | Possibility: ' || possibility || '%' || {NL} ||
    '  Est. Close: ' || est_close || ' | SO Plan: ' || plan_amount || coalesce(' | Solution: ' || solution, '') || coalesce(' | Sales: ' || person, '') || {NL} ||
    coalesce('  Stakeholders: ' || roles || {NL}, '') || CASE WHEN core_status <> 'Open' THEN '  Closed: ' || reason || ' | Date: ' || closed || {NL} ELSE '' END, '' ORDER BY deal_id) AS t
  FROM deal LEFT JOIN (SELECT l_orderkey AS deal_id, string_agg(l_returnflag, ', ' ORDER BY l_suppkey, l_returnflag) AS roles FROM lineitem GROUP BY 1) USING (deal_id)
  JOIN (SELECT deal_id, status AS core_status, priority AS reason, est_close AS closed FROM deal_core) USING (deal_id) GROUP BY 1"""


@query(
    "render_account_record",
    "SELECT 'account/' || account_id || '.md' AS path, body, substr(sha256(body), 1, 16) AS md_hash FROM account_doc",
    account_doc=re.sub(r"\(SELECT account_id, count\(\*\) AS n, string_agg\('- \*\*' \|\| deal_name.*?FROM deal GROUP BY 1\)", lambda _: f"({DEAL_LINES_SQL})", ACCOUNT_DOCS_SQL, flags=re.S),
    account_activity=ACTIVITIES_SQL,
)
def _(r):
    """Account documents with the stakeholders and the close line of each deal."""
    return docs.account_docs(*account_frames(r, deal_records(r))).select("path", "body", "md_hash")


@query(
    "refresh_corpus",
    """
SELECT 'account' AS doc_type, count(*) AS uploaded, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors FROM account
UNION ALL SELECT 'solution', count(DISTINCT solution), 0, 0 FROM deal
UNION ALL SELECT 'salesperson', count(DISTINCT person), 0, 0 FROM deal
UNION ALL SELECT 'industry', CAST(0 AS BIGINT), count(DISTINCT industry), 0 FROM account""",
)
def _(r):
    """The whole rebuild against a store that already holds the industry documents."""
    deals = materialize(flat_deals(r), "deals")
    stored = docs.corpus_union(industry=docs.industry_docs(r.account, deals))
    outcomes = upsert_outcome(stored, corpus(r, deals), ["doc_type", "path"])
    return upsert_report(outcomes, ["doc_type"])


SECTION_SQL = f"""
  SELECT account_id, idx, trim(CASE WHEN idx > 1 THEN '## ' || parts[idx] ELSE parts[idx] END, ' ' || {NL}) AS section
  FROM (SELECT account_id, parts, unnest(range(1, len(parts) + 1)) AS idx FROM (SELECT account_id, string_split(body, {NL} || '## ') AS parts FROM account_doc))"""
SECTION = {**ACCOUNT, "sections": SECTION_SQL}


@query("split_sections", "SELECT account_id, CAST(idx - 1 AS BIGINT) AS section_seq, section FROM sections WHERE section <> ''", **SECTION)
def _(r):
    rows = account_docs(r).select("doc_key", F.posexplode(split_sections(F.col("body"))).alias("pos", "section"))
    return rows.select(F.col("doc_key").cast("bigint").alias("account_id"), whole("pos", "section_seq"), "section")


@query("count_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS tokens FROM documents")
def _(r):
    return r.table("documents").select("doc_id", whole(count_tokens(F.col("text")), "tokens"))


def spans_sql(source: str, key: str, low: str, length: str) -> str:
    """Windows of 800 tokens with step 700 over ``length`` tokens from ``low``."""
    return f"""
  SELECT {key}, tokens, {low} + st AS first_token, least(800, {length} - st) AS n_tokens, {'idx' if low != '0' else '0'} AS idx
  FROM (SELECT *, unnest(range(0, greatest({length} - 100 - 1, 0) + 1, 700)) AS st FROM {source})"""


CHUNK_HASH = "sha256(array_to_string(list_slice(tokens, first_token + 1, first_token + n_tokens), ' '))"


@query(
    "sliding_window",
    f"""
SELECT doc_id, CAST(first_token // 700 AS BIGINT) AS window_seq, CAST(first_token AS BIGINT) AS first_token, CAST(n_tokens AS BIGINT) AS n_tokens,
       {CHUNK_HASH} AS content_hash FROM spans""",
    tok="  SELECT doc_id, regexp_extract_all(text, '\\S+') AS tokens, len(regexp_extract_all(text, '\\S+')) AS n FROM documents",
    spans=spans_sql("tok", "doc_id", "0", "n"),
)
def _(r):
    windows = sliding_windows(r.table("documents"), "doc_id", "text")
    return windows.select(
        "doc_id",
        whole("window_seq", "window_seq"),
        whole("first_token", "first_token"),
        whole("n_tokens", "n_tokens"),
        content_hash(collapse_space(F.col("content"))).alias("content_hash"),
    )


CHUNKS = {
    **SECTION,
    "tok": """
  SELECT account_id, idx, n, sum(n) OVER (PARTITION BY account_id ORDER BY idx) AS e, tokens FROM (
    SELECT account_id, idx, len(regexp_extract_all(section, '\\S+')) AS n FROM sections)
  JOIN (SELECT account_id, regexp_extract_all(body, '\\S+') AS tokens FROM account_doc) USING (account_id)""",
    "placed": "  SELECT *, CAST(greatest(e - n - 100, 0) AS BIGINT) AS lo, CAST(e - greatest(e - n - 100, 0) AS BIGINT) AS span FROM tok",
    "spans": spans_sql("placed", "account_id", "lo", "span"),
    "chunk": f"""
  SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY idx, first_token) - 1 AS chunk_seq, first_token, n_tokens, tokens,
         {CHUNK_HASH} AS content_hash FROM spans""",
}


def account_chunks(r):
    return chunk_document(account_docs(r), "doc_key", "body")


@query("chunk_document", "SELECT account_id, chunk_seq, content_hash FROM chunk", **CHUNKS)
def _(r):
    """Account documents in chunks; compared with white space collapsed, as tokens are what the rule is about."""
    return account_chunks(r).select(
        F.col("doc_key").cast("bigint").alias("account_id"),
        whole("chunk_seq", "chunk_seq"),
        content_hash(collapse_space(F.col("content"))).alias("content_hash"),
    )


@query("chunk_sequence", "SELECT account_id, max(chunk_seq) + 1 AS chunks, CAST(sum(chunk_seq) AS BIGINT) AS seq_sum FROM chunk GROUP BY 1", **CHUNKS)
def _(r):
    grouped = account_chunks(r).groupBy(F.col("doc_key").cast("bigint").alias("account_id"))
    return grouped.agg(whole(F.max("chunk_seq") + 1, "chunks"), whole(F.sum("chunk_seq"), "seq_sum"))


@query(
    "overlap_carry",
    "SELECT account_id, chunk_seq, CAST(n_tokens AS BIGINT) AS tokens, tokens[first_token + 1] AS first_token FROM chunk",
    **CHUNKS,
)
def _(r):
    """Every chunk starts with the tail of what came before: its first token and length show it."""
    text = collapse_space(F.col("content"))
    return account_chunks(r).select(
        F.col("doc_key").cast("bigint").alias("account_id"),
        whole("chunk_seq", "chunk_seq"),
        whole(F.size(F.split(text, " ")), "tokens"),
        F.split(text, " ")[0].alias("first_token"),
    )


@query(
    "embed_batch",
    r"""
WITH word AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS w FROM documents),
bin AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS b FROM word),
part AS (SELECT doc_id, b // 2 AS d, sum(CASE WHEN b % 2 = 1 THEN 1 ELSE -1 END) AS c FROM bin GROUP BY ALL),
norm AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM part GROUP BY doc_id),
cell AS (SELECT k.doc_id, g.d, CAST(coalesce(c / CASE WHEN n > 0 THEN n ELSE 1 END, 0) AS FLOAT) AS x
  FROM documents k CROSS JOIN range(64) g(d) LEFT JOIN part p ON p.doc_id = k.doc_id AND p.d = g.d LEFT JOIN norm o ON o.doc_id = k.doc_id)
SELECT doc_id, CAST(count(*) AS BIGINT) AS dims, string_agg(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT), ',' ORDER BY d) AS components
FROM cell GROUP BY doc_id""",
)
def _(r):
    """Every component of the default encoder, in millionths."""
    vectors = embed_batch(r.table("documents"), "doc_id", "text")
    millionths = F.transform("vector", lambda x: F.floor(x.cast("double") * 1000000).cast("string"))
    return vectors.select("doc_id", whole(F.size("vector"), "dims"), F.array_join(millionths, ",").alias("components"))


def vowel_shares(batch: list[str]) -> np.ndarray:
    """A stand-in for a user's model: the share of each vowel in a text."""
    return np.array([[text.count(v) / max(len(text), 1) for v in "aeiou"] for text in batch])


@query(
    "encoder",
    """
SELECT doc_id, CAST(5 AS BIGINT) AS dims, round((length(text) - length(replace(text, 'a', ''))) / greatest(length(text), 1), 4) AS a_share FROM documents""",
)
def _(r):
    """A user's encoder in place of the default one."""
    vectors = embed_batch(r.table("documents"), "doc_id", "text", vowel_shares, batch=32)
    return vectors.select("doc_id", whole(F.size("vector"), "dims"), F.round(F.col("vector")[0].cast("double"), 4).alias("a_share"))


@query(
    "tokenizer",
    """
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines,
       CAST(greatest(ceil((len(string_split(text, chr(10))) - 2) / 18.0), 1) AS BIGINT) AS chunks FROM documents""",
)
def _(r):
    """A user's tokenizer in place of the default one: a line is a token, 20 per chunk, 2 carried."""
    documents = r.table("documents").select("doc_id", "text")
    chunks = chunk_document(documents, "doc_id", "text", size=20, overlap=2, tokenizer=lambda c: F.regexp_extract_all(c, F.lit("[^\n]*\n"), F.lit(0)))
    counted = chunks.groupBy("doc_id").agg(whole(F.count(F.lit(1)), "chunks"))
    lines = documents.select("doc_id", whole(F.size(F.split("text", "\n")), "lines"))
    return lines.join(counted, "doc_id").select("doc_id", "lines", "chunks")
