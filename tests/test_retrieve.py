import hashlib
import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from salesloom.operators import postings
from salesloom.operators import retrieve as rt
from salesloom.operators.cells import VectorGroup

SF = "/root/testdata/sf0.01"


def store(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), df.select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
    )


def brute(spark, k):
    rows = sorted((r.item_id, r.vector) for r in store(spark)[1].collect())
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    return {int(q): [int(ids[j]) for j in np.lexsort((ids, -s[i]))[:k]] for i, q in enumerate(ids)}


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def test_exact_search_in_any_number_of_blocks(spark):
    queries, corpus = store(spark)
    expected = brute(spark, 5)
    assert lists(rt.knn_cosine(queries, corpus, 5)) == expected
    assert lists(rt.knn_cosine(queries, corpus, 5, query_block=120, corpus_block=70)) == expected


def test_copies_rank_by_id_and_zero_vectors_stay_out(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(99, [0.0, 0.0])], "item_id bigint, vector array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, vector array<float>")
    for block in (5, 20_000):
        assert lists(rt.knn_cosine(queries, corpus, 3, corpus_block=block)) == {1: [0, 1, 2]}


def test_approximate_search_recall(spark):
    queries, corpus = store(spark)
    expected = brute(spark, 5)
    got = lists(rt.knn_approx(queries, corpus, 5))
    recall = np.mean([len(set(got.get(q, [])) & set(hits)) / 5 for q, hits in expected.items()])
    assert recall >= 0.9, recall
    split = lists(rt.knn_approx(queries, corpus, 5, query_block=40, corpus_block=10))
    recall = np.mean([len(set(split.get(q, [])) & set(hits)) / 5 for q, hits in expected.items()])
    assert recall >= 0.9, recall


def clusters(spark, n=4000, centers=50, dim=16):
    """Vectors around some directions, a third of all around one, with copies, scaled ones and unusable ones."""
    rng = np.random.default_rng(9)
    around = rng.standard_normal((centers, dim))
    own = np.where(rng.random(n) < 0.33, 0, rng.integers(0, centers, n))
    rows = around[own] + 0.15 * rng.standard_normal((n, dim))
    rows[:30] = rows[30]
    rows[40:60] *= 1000
    listed = [(i, v.tolist()) for i, v in enumerate(rows)]
    listed += [(n, [0.0] * dim), (n + 1, None), (n + 2, [float("nan")] * dim), (n + 3, [None, *[1.0] * (dim - 1)])]
    corpus = spark.createDataFrame(listed, "item_id bigint, vector array<double>").cache()
    return corpus.where(f"item_id % 10 = 0 OR item_id >= {n}").withColumnRenamed("item_id", "query_id"), corpus, rows


def brute_rows(queries, rows, k):
    m = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    return {q: np.lexsort((np.arange(len(m)), -s[q]))[:k].tolist() for q in queries}


def test_cells_skip_what_cannot_reach_the_best(spark):
    queries, corpus, rows = clusters(spark)
    expected = brute_rows(range(0, len(rows), 10), rows, 5)
    for blocks in ({}, {"query_block": 150, "corpus_block": 100}):
        assert lists(rt.knn_cosine(queries, corpus, 5, cells=50, **blocks)) == expected
    scored = rt.knn_pairs(queries, corpus, 5, cells=50).agg(F.sum("scored")).first()[0]
    assert scored < 0.5 * len(expected) * len(rows)  # a third of all is one cluster, which its own must meet
    assert rt.knn_pairs(queries, corpus, 5, cells=1).first().scored == len(expected) * len(rows)


def test_learned_estimate_skips_more(spark):
    queries, corpus, rows = clusters(spark)
    expected = brute_rows(range(0, len(rows), 10), rows, 5)
    hits = rt.knn_approx(queries, corpus, 5)
    got = lists(hits)
    assert np.mean([len(set(got.get(q, [])) & set(found)) / 5 for q, found in expected.items()]) >= 0.9
    exact = {(r.query_id, r.item_id): r.score for r in rt.knn_cosine(queries, corpus, 50).collect()}
    assert all(exact[r.query_id, r.item_id] == r.score for r in hits.collect() if (r.query_id, r.item_id) in exact)


def test_search_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "bolt", [1.0, 0.0])], "query_id bigint, text string, vector array<double>")
    none = asked.limit(0)
    items = asked.withColumnRenamed("query_id", "item_id")
    for queries, corpus in ((asked, empty), (none, items), (none, empty)):
        assert rt.knn_cosine(queries, corpus, 3).count() == 0
        assert rt.knn_approx(queries, corpus, 3).count() == 0
        assert rt.keyword_score(queries, corpus, 3).count() == 0
        assert rt.hybrid_search(queries, corpus, 3).count() == 0


def test_keyword_score_against_the_formula(spark):
    docs = {1: "red bolt red", 2: "blue bolt", 3: "Red, RED; nut!", 4: "nothing here", 5: ""}
    queries = {7: "red bolt", 8: "absent", 9: "nut nut"}
    words = {d: re.findall(r"\w+", s.lower()) for d, s in docs.items()}
    avg = sum(map(len, words.values())) / len(docs)
    expected = {}
    for q, text in queries.items():
        for d, tokens in words.items():
            score, tf = 0.0, Counter(tokens)
            for term in set(re.findall(r"\w+", text)):
                df = sum(term in w for w in words.values())
                if tf[term]:
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    score += idf * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(tokens) / avg))
            if score:
                expected[q, d] = round(score, 6)
    q = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    c = spark.createDataFrame(list(docs.items()), "item_id bigint, text string")
    for blocks in ({}, {"query_block": 1, "corpus_block": 1}):
        got = {(r.query_id, r.item_id): r.score for r in rt.keyword_score(q, c, 10, **blocks).collect()}
        assert got == expected


def test_keyword_blocks_are_skipped_below_the_bar(spark, monkeypatch):
    rng = np.random.default_rng(6)
    common, rare = [f"w{i}" for i in range(20)], [f"rare{i}" for i in range(60)]
    texts = [" ".join([*rng.choice(common, rng.integers(1, 40)), *rng.choice(rare, rng.integers(0, 3))]) for _ in range(400)]
    corpus = spark.createDataFrame(list(enumerate(texts)) + [(400, None), (401, "")], "item_id bigint, text string")
    asked = spark.createDataFrame([(i, " ".join([*rng.choice(common, 4), rare[i]])) for i in range(40)] + [(99, None)], "query_id bigint, text string")
    whole = lists(rt.keyword_score(asked, corpus, 4))
    monkeypatch.setattr(postings, "FIRST", 3)
    monkeypatch.setattr(postings, "SENT_BYTES", 900)  # several parts of the queries
    assert lists(rt.keyword_score(asked, corpus, 4, query_block=7, corpus_block=9)) == whole
    part = postings.listed(asked)
    stored = postings.Postings(part, corpus, block=9)
    group = next(rt.groups(part))
    known = stored.group(group)
    batches = stored.items.toArrow().combine_chunks().to_batches()
    met = [len(rows) for rows, _, _ in known.blocks(batches, lambda: stored.first_bars(group, 4), None)]
    assert 0 < sum(met) < 0.9 * len(known.ids) * math.ceil(402 / 9)


def test_texts_are_split_some_bytes_at_a_time():
    """What a task splits at a time does not grow with the rows of a batch: one text, and others of so many bytes together."""
    texts = ["a b " * 50, None, "", "word " * 900, *["x y z"] * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["item_id", "text"])
    parts = list(postings.slices(batch, 1000))
    assert [t for part in parts for t in part.column(1).to_pylist()] == texts
    assert all(sum(len(t or "") for t in part.column(1).to_pylist()[1:]) <= 1000 for part in parts) and len(parts) == 4
    assert list(postings.slices(batch.slice(0, 0))) == []


def vector_group(rng, n, cells, dim=16):
    asked = pa.table({"query_id": np.arange(n), "vector": pa.array(rng.standard_normal((n, dim)).tolist())})
    centers = rng.standard_normal((cells, dim))
    return VectorGroup(asked, centers / np.linalg.norm(centers, axis=1, keepdims=True), None, 100)


def test_a_group_of_queries_holds_nothing_per_cell():
    rng = np.random.default_rng(3)
    few, many = (len(pickle.dumps(vector_group(rng, 2000, cells))) for cells in (10, 1000))
    assert many - few < 2 * 1000 * 16 * 8  # the centroids


def test_only_what_may_reach_its_bar_is_scored():
    rng = np.random.default_rng(8)
    group, rows = vector_group(rng, 300, 4), rng.standard_normal((500, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(rows.tolist())], ["item_id", "vector"])
    exact = np.round(group.units @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T, 6)
    bars = np.sort(exact, axis=1)[:, -3]  # three items of each query, and those that tie
    found, scored = set(), 0
    for part, scores, ids in group.leading([batch], lambda: bars):
        scored += scores.size
        row, at = np.nonzero(scores >= bars[part][:, None])
        found |= set(zip(part[row].tolist(), ids[at].tolist(), scores[row, at].tolist()))
    row, at = np.nonzero(exact >= bars[:, None])
    assert found == set(zip(row.tolist(), at.tolist(), exact[row, at].tolist()))
    assert scored < exact.size
    empty = group.leading([batch], lambda: np.full(300, -np.inf))
    assert sum(scores.size for _, scores, _ in empty) == exact.size  # without a bar every item is scored


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, item_id int, content string, score double, rank int")


def test_merge(spark):
    same = "x" * 120
    first = hits(spark, (1, 10, same + "a", 0.5, 1), (1, 11, "only first", 0.4, 2), (1, 12, " ", 0.9, 3))
    second = hits(spark, (1, 20, same + "b", 9.0, 1), (1, 21, "only second", 2.0, 2))
    raw = [r.item_id for r in rt.merge_hits(first, second, 8, prefix=120).orderBy("merged_rank").collect()]
    assert raw == [21, 10, 11]  # the first list wins the shared text, blank text goes
    rrf = [r.item_id for r in rt.merge_hits(first, second, 8, mode="rrf", prefix=120).orderBy("merged_rank").collect()]
    assert rrf == [10, 11, 21]
    assert rt.merge_hits(first, second, 1).count() == 1
    assert rt.merge_hits(first, second, 8).count() == 4  # texts that only begin alike are two hits


def pack(spark, *lengths):
    df = spark.createDataFrame([(1, i + 1, "b" * n) for i, n in enumerate(lengths)], "query_id int, rank int, block string")
    return [(r.rank, len(r.text), r.truncated) for r in rt.context_budget(df, 1000, 100).orderBy("rank").collect()]


def test_context_budget(spark):
    mark = len("\n[truncated]")
    assert pack(spark, 400, 600) == [(1, 400, False), (2, 600, False)]
    assert pack(spark, 400, 700, 10) == [(1, 400, False), (2, 600 + mark, True)]  # nothing after the first overflow
    assert pack(spark, 900, 200, 10) == [(1, 900, False)]  # a tail of 100 is too short
    assert pack(spark, 899, 200) == [(1, 899, False), (2, 101 + mark, True)]
    assert pack(spark, 1000, 5) == [(1, 1000, False)]
    assert pack(spark, 5000) == [(1, 1000 + mark, True)]
    assert pack(spark, *[0] * 1200, 7) == [(1201, 7, False)]  # empty blocks take no room


def test_context_text(spark):
    rows = spark.createDataFrame([(1, 1, "a1", " body ", 0.5), (1, 2, "a2", "b", 1.25)], "query_id int, rank int, account_id string, content string, score double")
    names = spark.createDataFrame([("a1", "Acme")], "account_id string, account_name string")
    text = rt.build_context(rows, names).first().context
    assert text.startswith("[1] Account: Acme (account_id a1) (similarity: 0.500)\nbody\n\n[2] Account: a2 (")


def test_embedding_batches_keep_order(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "k int, t string").repartition(3)
    seen = rt.embed_batch(df, "k", "t", lambda batch: np.array([[float(x.split()[1]), len(batch)] for x in batch]), batch=16)
    got = seen.collect()
    assert all(r.vector[0] == r.k and r.vector[1] <= 16 for r in got) and len(got) == 50


def test_default_encoder_counts_signed_words_without_python(spark):
    texts = [None, "", " - ", "Bolt bolt, NUT", "ปี2569 ศูนย์ bolt", "a b c d e f g " * 40_000, *(f"row {i} of {i % 7}" for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)

    def brute(text, dim):
        counts = np.zeros(dim)
        for word in regex.findall(r"[\p{L}\p{M}\p{N}_]+", (text or "").lower()):
            b = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (2 * dim)
            counts[b // 2] += 1 if b % 2 else -1
        return (counts / (np.sqrt((counts**2).sum()) or 1)).astype(np.float32).tolist()

    for dim in (64, 5):
        got = {r.k: r.v for r in df.select("k", rt.hashed_words(F.col("t"), dim).alias("v")).collect()}
        assert got == {k: brute(t, dim) for k, t in enumerate(texts)}
    plan = rt.embed_batch(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


def test_score_fallback(spark):
    df = spark.createDataFrame([(0.0, 0.3), (None, 0.4), (0.9, 0.1), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(rt.score_fallback(F.col("a"), F.col("b"))).collect()] == [0.3, 0.4, 0.9, 0.0]


def test_hybrid_search_sees_ranks_below_any_depth(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 8)).round(3)
    said = [" ".join(["bolt"] * int(rng.integers(1, 9)) + ["nut"] * int(rng.integers(0, 9)) + ["pin"] * int(rng.integers(1, 30))) for _ in range(300)]
    said[0], vectors[0] = "bolt nut", -vectors[1]
    corpus = spark.createDataFrame([(i, t, v.tolist()) for i, (t, v) in enumerate(zip(said, vectors))], "item_id bigint, text string, vector array<double>")
    queries = spark.createDataFrame([(1, "bolt nut", vectors[1].tolist()), (2, "nut", vectors[2].tolist()), (3, "pin", None)], "query_id bigint, text string, vector array<double>")
    near = rt.knn_cosine(queries.where("vector IS NOT NULL"), corpus, 300)
    want = lists(rt.fuse_ranks([near, rt.keyword_score(queries, corpus, 300)], 5))
    for blocks in ({}, {"query_block": 1, "corpus_block": 40}):
        assert lists(rt.hybrid_search(queries, corpus, 5, **blocks)) == want
    scores = {(r.query_id, r.item_id): r.score for r in rt.fuse_ranks([near, rt.keyword_score(queries, corpus, 300)], 5).collect()}
    assert {(r.query_id, r.item_id): r.score for r in rt.hybrid_search(queries, corpus, 5).collect()} == scores
    assert scores != {(r.query_id, r.item_id): r.score for r in rt.hybrid_search(queries, corpus, 5, depth=50).collect()}
