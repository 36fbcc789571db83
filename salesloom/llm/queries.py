"""The registered queries of the operators here, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.llm.common import ROW, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"


def words_sql(text: str, gap: str, lower: bool) -> str:
    """The list of words of a text in DuckDB: split at the gaps, without empty ends."""
    text = f"coalesce({text}, '')"
    return f"[w FOR w IN regexp_split_to_array({LOWER.format(text) if lower else text}, '{gap}') IF w <> '']"


OP1_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql("text", NOT_ALNUM, True)} AS w FROM documents),
b AS (SELECT item_id, {words_sql("text", NOT_ALNUM, True)} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN r USING (k) GROUP BY 1"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark, sf_dir):
    from salesloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(ROW)


@query("op8_line_dedup", OP8_SQL)
def op8(spark, sf_dir):
    from salesloom.llm.lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql("text", SPACE, True)} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) USING (doc_id)"""


@query("op3_ngram_jaccard", OP3_SQL)
def op3(spark, sf_dir):
    from salesloom.llm.jaccard import GROUP, jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).drop(ROW, GROUP)


@query("op4_mix_sources")
def op4(spark, sf_dir):
    from salesloom.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark, sf_dir):
    from salesloom.llm.language import fit, fold, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, fold(F.col("doc_id"), 3) != 1))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP6_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql("text", SPACE, False)} AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT doc_id, i FROM x WHERE win IN (SELECT win FROM x GROUP BY 1 HAVING count(*) > 1)),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT word.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query("op6_substring_dedup", OP6_SQL)
def op6(spark, sf_dir):
    from salesloom.llm.rlz import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("kept", "kept_sha256")


@query("op9_toxicity")
def op9(spark, sf_dir):
    from salesloom.llm.compression import fit, score
    from salesloom.llm.language import fold

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", "toxic", fold(F.col("doc_id"), 5) != 0)
    return score(docs, model, 5, 0)


@query("op10_quality")
def op10(spark, sf_dir):
    from salesloom.llm.compression import fit, score
    from salesloom.llm.language import fold

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", "quality", fold(F.col("doc_id"), 3) != 1)
    return score(docs, model, 3, 1)


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.vec_id),
ids AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM ids LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)"""


@query("op2_embedding_dedup", OP2_SQL)
def op2(spark, sf_dir):
    from salesloom.llm.forest import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_html_text")
def op5(spark, sf_dir):
    from salesloom.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


#: CRC-32 of a decimal text, bit by bit: an element from 0 on is a byte to take in, -1 a shift.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
    flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({}, '')])),
    LAMBDA a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END))"""


def leaf_sql(n_chars: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP11_SQL = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {leaf_sql("n_chars")} AS leaf,
         CASE WHEN {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf_sql("(n_chars + 1)")} ELSE {leaf_sql("n_chars")} END AS given FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaf),
tree AS (
  SELECT g, 0 AS lvl, p, leaf AS node, n FROM placed
  UNION ALL SELECT g, lvl + 1, p // 2, sha256(string_agg(node, '' ORDER BY p)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, p // 2, (n + 1) // 2),
subroots AS MATERIALIZED (SELECT g, lvl AS height, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS gp, count(*) OVER () AS gn FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, gp AS p, subroot AS node, gn AS n FROM subroots
  UNION ALL SELECT lvl + 1, p // 2, sha256(string_agg(node, '' ORDER BY p)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, p // 2, (n + 1) // 2),
path AS MATERIALIZED (
  SELECT x.g, x.p AS own, t.lvl, t.p, t.node FROM placed x JOIN tree t ON t.g = x.g AND t.n > 1 AND t.p = xor(x.p >> t.lvl, 1)
  UNION ALL SELECT x.g, x.p, height + t.lvl, t.p, t.node FROM placed x JOIN subroots s USING (g) JOIN top t ON t.n > 1 AND t.p = xor(s.gp >> t.lvl, 1)),
proofs AS (SELECT g, own AS p, string_agg(node, '' ORDER BY lvl) AS proof FROM path GROUP BY 1, 2),
fold AS (
  SELECT x.g, x.p AS own, 0 AS lvl, x.p AS here, x.n AS n, x.given AS node, false AS up FROM placed x
  UNION ALL
  SELECT f.g, f.own, CASE WHEN f.n > 1 THEN f.lvl + 1 ELSE f.lvl END, CASE WHEN f.n > 1 THEN f.here // 2 ELSE s.gp END, CASE WHEN f.n > 1 THEN (f.n + 1) // 2 ELSE s.gn END,
         CASE WHEN f.n <= 1 THEN f.node WHEN h.node IS NULL THEN sha256(f.node) WHEN f.here % 2 = 0 THEN sha256(f.node || h.node) ELSE sha256(h.node || f.node) END,
         f.up OR f.n <= 1
  FROM fold f JOIN subroots s ON s.g = f.g LEFT JOIN path h ON h.g = f.g AND h.own = f.own AND h.lvl = f.lvl AND f.n > 1
  WHERE f.n > 1 OR NOT f.up)
SELECT x.doc_id, x.leaf, s.subroot, r.root, sha256(coalesce(proof, '')) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM placed x JOIN subroots s USING (g) JOIN (SELECT node AS root FROM top WHERE n = 1) r ON true
LEFT JOIN proofs USING (g, p) JOIN fold f ON f.g = x.g AND f.own = x.p AND f.n = 1 AND f.up"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark, sf_dir):
    from salesloom.llm.merkle import merkle_proofs, seventh

    rows = merkle_proofs(table(spark, sf_dir, "documents"), seventh(F.col("doc_id")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@query("op12_lm_score")
def op12(spark, sf_dir):
    from salesloom.llm.ctw import lm_scores
    from salesloom.llm.language import fold

    part = fold(F.col("doc_id"), 10)
    return lm_scores(table(spark, sf_dir, "documents"), part != 0, part == 0)


OP13_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql("text", NOT_ALNUM, True)} AS w FROM documents),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({words_sql("text", NOT_ALNUM, True)}) AS term FROM benchmark) GROUP BY 1, 2),
hit AS (
  SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN t USING (term) JOIN f USING (term) JOIN n USING (doc_id), size GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit WHERE score > 0) WHERE rank <= 10"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark, sf_dir):
    from salesloom.llm.maxsketch import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
