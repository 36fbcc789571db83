"""Top-k retrieval for a whole table of queries: exact, filtered, keyword, hybrid, approximate.

Items stay where they are and are scored in blocks (``search.py``); vectors lie in learned cells
whose bounds tell which queries a block need not meet (``cells.py``), texts in posting blocks
(``postings.py``). A task returns only its best k per query, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from salesloom.operators.cells import CALIBRATE, Cells
from salesloom.operators.postings import Postings, listed, parts
from salesloom.operators.search import CORPUS_BLOCK, DIGITS, QUERY_BLOCK, Searched, groups, top_hits, union
from salesloom.session import materialize


def _vectors(queries: DataFrame) -> DataFrame:
    return queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "vector")


def knn_cosine(queries: DataFrame, corpus: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK, cells: int | None = None) -> DataFrame:
    """``queries(query_id, vector)`` against ``corpus(item_id, vector)``: query_id, item_id, score, rank."""
    stored = Cells(corpus, cells, block=corpus_block)
    return top_hits(union([stored.nearest(group, k) for group in groups(_vectors(queries), query_block)]), k)


def knn_filtered(queries: DataFrame, corpus: DataFrame, ids: DataFrame, k: int = 5, **blocks: int) -> DataFrame:
    """The same restricted to the accounts listed in ``ids(account_id)``; the filter runs before scoring."""
    return knn_cosine(queries, corpus.join(ids.select("account_id").distinct(), "account_id", "left_semi"), k, **blocks)


def knn_pairs(queries: DataFrame, corpus: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK, cells: int | None = None) -> DataFrame:
    """How many pairs ``knn_cosine`` scores at most: ``scored``, one row a group of queries."""
    stored = Cells(corpus, cells, block=corpus_block)
    return union([stored.pairs(group, k) for group in groups(_vectors(queries), query_block)])


def keyword_score(queries: DataFrame, corpus: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """BM25 (Robertson and Zaragoza) of ``queries(query_id, text)`` over ``corpus(item_id, text)``; the texts are read once a part of the queries."""
    found = []
    for part in parts(listed(queries)):
        stored = Postings(part, corpus, k1, b, corpus_block)
        found += [stored.best(group, k) for group in groups(part, query_block)]
    return top_hits(union(found), k)


def fuse_ranks(legs: Sequence[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion (Cormack, Clarke and Buettcher 2009) of ranked hit lists."""
    whole = None
    for leg in legs:
        rows = leg.select("query_id", "item_id", (F.lit(1.0) / (constant + F.col("rank"))).alias("part"))
        whole = rows if whole is None else whole.unionByName(rows)
    fused = whole.groupBy("query_id", "item_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return top_hits(fused, k)


def _seen_depth(k: int, constant: int = 60) -> int:
    """A depth below which, in both legs, no item can be among the k best: k items of a leg have 1 / (constant + k) each."""
    bar = 1 / (constant + k) - 2 * 10.0**-DIGITS
    if bar <= 0:
        raise ValueError(f"k is too large for scores of {DIGITS} digits")
    return max(k, math.ceil(2 / bar - constant))


def _legs(stored: Searched, asked: pa.Table, leg: DataFrame, either: DataFrame) -> DataFrame:
    """Every candidate's rank in a leg: of those among its hits as it is, of the others counted in the whole corpus."""
    own = either.join(leg.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left_anti")
    pairs = own.select("query_id", "item_id", F.lit(None).cast("double").alias("score")).toArrow()
    return leg.select("query_id", "item_id", "rank").unionByName(stored.ranks(asked, pairs))


def hybrid_search(
    queries: DataFrame, corpus: DataFrame, k: int = 5, depth: int | None = None, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK
) -> DataFrame:
    """Vector and keyword leg fused to one list of k, by the ranks in the whole corpus.

    Queries and items without a vector take part in the keyword leg alone. Only items near the top
    of a leg can be among the k best; they get their true rank in the other leg, counted block by
    block. With ``depth`` each leg is cut there instead, and what ranks lower in both can be missed.
    """
    stored = corpus.where("vector IS NOT NULL").select("item_id", "vector")
    if depth is not None:
        blocks = {"query_block": query_block, "corpus_block": corpus_block}
        return fuse_ranks([knn_cosine(queries, stored, depth, **blocks), keyword_score(queries, corpus, depth, **blocks)], k)
    seen = _seen_depth(k)
    vectors, fused = Cells(stored, block=corpus_block), []
    for part in parts(listed(queries)):
        texts = Postings(part, corpus, block=corpus_block)
        for group in groups(part.join(_vectors(queries), "query_id", "left"), query_block):
            near = materialize(top_hits(vectors.nearest(group, seen), seen), "near")
            words = materialize(top_hits(texts.best(group, seen), seen), "words")
            either = near.select("query_id", "item_id").unionByName(words.select("query_id", "item_id")).distinct()  # at most 2 * seen a query
            fused.append(fuse_ranks([_legs(vectors, group, near, either), _legs(texts, group, words, either)], k))
    return union(fused)


def knn_approx(
    queries: DataFrame, corpus: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK, cells: int | None = None
) -> DataFrame:
    """Approximate top-k: a cell is left out where its estimate, learned from some of the queries, is below a query's bar.

    Scores are exact, only membership is approximate. There are about as many cells as a cell has
    vectors; a corpus of fewer than four vectors a cell is searched exactly.
    """
    n = corpus.where("vector IS NOT NULL").count()
    stored = Cells(corpus, max(2, math.isqrt(n)) if cells is None else cells, block=corpus_block)
    asked = materialize(_vectors(queries), "asked")
    share = max(4, math.ceil(asked.count() / CALIBRATE))
    learned = asked.where(F.pmod(F.xxhash64("query_id", F.lit("calibrate")), F.lit(share)) == 0).limit(2 * CALIBRATE).toArrow()
    stored = stored.calibrated(learned, k)
    return top_hits(union([stored.nearest(group, k) for group in groups(asked, query_block)]), k)


def score_fallback(rerank: Column, score: Column) -> Column:
    """The second-stage score when it is there and not zero, else the first, else 0."""
    return F.coalesce(F.nullif(rerank, F.lit(0.0)), score, F.lit(0.0))


def merge_hits(first: DataFrame, second: DataFrame, k: int = 8, mode: str = "raw", prefix: int | None = None) -> DataFrame:
    """Two hit lists ``(query_id, item_id, content, score, rank)`` as one.

    Hits with the same trimmed content are one hit (with ``prefix``: the same first characters),
    the earlier list and rank winning; blank content is dropped. ``raw`` sorts by score as it came, ``rrf`` by reciprocal ranks.
    """
    both = first.withColumn("source", F.lit(1)).unionByName(second.withColumn("source", F.lit(2)))
    content = F.coalesce("content", F.lit(""))
    content = F.trim(content if prefix is None else F.substring(content, 1, prefix))
    both = both.where(content != "").withColumn("_same", F.sha2(content, 256))
    if mode == "rrf":
        votes = both.groupBy("query_id", "_same").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), DIGITS).alias("_vote"))
        both = both.join(votes, ["query_id", "_same"]).withColumn("score", F.col("_vote")).drop("_vote")
    earliest = Window.partitionBy("query_id", "_same").orderBy("source", "rank")
    unique = both.withColumn("_rn", F.row_number().over(earliest)).where("_rn = 1").drop("_rn", "_same")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source", "rank")
    return unique.withColumn("merged_rank", F.row_number().over(best)).where(F.col("merged_rank") <= k)


def context_budget(blocks: DataFrame, max_chars: int = 8000, min_tail: int = 100) -> DataFrame:
    """Whole blocks ``(query_id, rank, block)`` in rank order while they fit in ``max_chars``.

    The first block that does not fit is cut to what is left if that is more than ``min_tail``;
    everything behind it goes. Empty blocks are left out.
    """
    usable = blocks.where(F.length("block") > 0)
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = usable.withColumn("_before", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0).cast("bigint")))
    left = F.lit(max_chars) - F.col("_before")
    fits = F.length("block") <= left
    tail = F.concat(F.substring(F.col("block"), F.lit(1), left.cast("int")), F.lit("\n[truncated]"))
    return (
        used.withColumn("text", F.when(fits, F.col("block")).when(left > min_tail, tail))
        .where(F.col("text").isNotNull() & (left > 0))
        .select("query_id", "rank", "text", (~fits).alias("truncated"))
    )


def context_blocks(hits: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The header and text of each hit ``(query_id, rank, account_id, content, score)``."""
    label = F.col("account_id").cast("string")
    if names is not None:
        hits = hits.join(names.select("account_id", "account_name"), "account_id", "left")
        named = F.concat(F.col("account_name"), F.lit(" (account_id "), label, F.lit(")"))
        label = F.when(F.col("account_name") != "", named).otherwise(F.concat(label, F.lit(" (ไม่พบชื่อ)")))
    header = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] Account: "), label,
        F.lit(" (similarity: "), F.replace(F.format_number(F.col("score"), 3), F.lit(","), F.lit("")), F.lit(")"),
    )
    return hits.select(
        "query_id", "rank", F.concat(header, F.lit("\n"), F.trim("content"), F.lit("\n")).alias("block")
    )


def build_context(hits: DataFrame, names: DataFrame | None = None, max_chars: int = 8000) -> DataFrame:
    """One context text per query: the packed blocks joined by newlines."""
    packed = context_budget(context_blocks(hits, names), max_chars)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("context"))


def embed_batch(
    texts: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray] | None = None, batch: int = 16
) -> DataFrame:
    """``key, vector`` of every text: ``hashed_words`` without a Python worker, or a model of the
    caller's, which gets ``batch`` texts at a time inside each Arrow batch. A null text is an empty one."""
    if encoder is None:
        return texts.select(key, hashed_words(F.col(text)).alias("vector"))
    schema = texts.select(key).schema.add("vector", ArrayType(FloatType()))

    def run(frames):
        for frame in frames:
            values = frame[text].fillna("").tolist()
            parts = [np.asarray(encoder(values[i : i + batch]), dtype=np.float32) for i in range(0, len(values), batch)]
            vectors = [row for part in parts for row in part]
            yield pd.DataFrame({key: frame[key], "vector": vectors})

    return texts.select(key, text).mapInPandas(run, schema)


def hashed_words(text: Column, dim: int = 64) -> Column:
    """The default encoder: signed hashed word counts, unit length (zeros without words); needs no model file.

    The first 32 bits of a word's MD5, modulo ``2 * dim``, are its bin: half of it is the component, an odd
    bin adds one and an even one takes one away. The bins of a text are sorted with one mark of each
    between them, so the distance of two marks is a count and the work stays linear in a long text.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    bins = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % (2 * dim))
    ordered = F.sort_array(F.concat(bins, F.sequence(F.lit(0).cast("long"), F.lit(2 * dim).cast("long"))))
    marks = _once(ordered, lambda o: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(2 * dim).cast("long")), lambda m: F.array_position(o, m)))
    signed = _once(marks, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: m[2 * d + 2] - 2 * m[2 * d + 1] + m[2 * d]))

    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x * x))
        return _once(norm, lambda n: F.transform(counts, lambda x: (x / F.when(n > 0, n).otherwise(1.0)).cast("float")))

    return _once(signed, unit)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]
