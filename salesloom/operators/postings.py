"""Keyword ranking (BM25, Robertson and Zaragoza) over posting blocks that know their greatest weights.

One pass over the texts keeps, per item, its length and how often it has each term that some query
has; nothing is shuffled for it, and no posting is copied. A task reads its items in blocks, and
inverts each: a block's postings by term, with each term's greatest weight. A query whose
greatest weights in a block stay below its bar skips the block. The bar is the k-th best score of
a first round over one block in ``FIRST``, and what the task has found since.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.operators.search import CHUNK, CORPUS_BLOCK, DIGITS, Searched, ship, top_hits, unpack
from salesloom.session import materialize

FIRST = 16
SENT_BYTES = 64 << 20  # terms of queries that are sent to the tasks at a time
SCAN_BYTES = 2 << 20  # texts that a task splits into words at a time


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts (runs of letters and digits, in lower case), each one's text, and how many each text has."""
    listed = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    row, word = pc.list_parent_indices(listed).to_numpy(), listed.flatten()
    real = pc.not_equal(word, "")  # at the ends of a text
    row = row[real.to_numpy(zero_copy_only=False)]
    return word.filter(real), row, np.bincount(row, minlength=len(texts))


def slices(batch: pa.RecordBatch, most: int = SCAN_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts (the second column) have about ``most`` bytes together: what is split at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // most)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def listed(queries: DataFrame) -> DataFrame:
    """``query_id, terms``: the distinct words of each query, the form in which groups of queries are sent."""

    def scan(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            word, row, _ = split(batch.column(1))
            codes = word.dictionary_encode()
            pairs = np.unique(row * (len(codes.dictionary) + 1) + codes.indices.to_numpy())
            row, code = np.divmod(pairs, len(codes.dictionary) + 1)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(edges), codes.dictionary.take(pa.array(code)))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms], ["query_id", "terms"])

    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), "text")
    return materialize(rows.mapInArrow(scan, "query_id long, terms array<string>"), "asked")


def parts(asked: DataFrame) -> list[DataFrame]:
    """The queries in parts whose terms have about ``SENT_BYTES`` together: one, unless there are very many."""
    size = asked.agg(F.coalesce(F.sum(F.octet_length(F.array_join("terms", "")) + 16 * F.size("terms")), F.lit(0)).alias("b")).first().b
    n = max(1, math.ceil(size / SENT_BYTES))
    return [asked] if n == 1 else [asked.where(F.pmod(F.xxhash64("query_id", "terms"), F.lit(n)) == i) for i in range(n)]


def item_terms(vocabulary: pa.Array, corpus: DataFrame) -> DataFrame:
    """Per item its length in words, and which terms of the vocabulary it has how often: a written table."""
    sent = ship(corpus.sparkSession, vocabulary)

    def count(batches):
        known = unpack(sent)
        for batch in (part for whole in batches for part in slices(whole)):
            word, row, sizes = split(batch.column(1))
            codes = pc.index_in(word, value_set=known)
            row, code = row[pc.is_valid(codes).to_numpy(zero_copy_only=False)], codes.drop_null().to_numpy().astype(np.int64)
            pairs, times = np.unique(row * (len(known) + 1) + code, return_counts=True)
            row, code = np.divmod(pairs, len(known) + 1)
            edges = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
            held = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (code, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), *held], ["item_id", "length", "terms", "times"])

    texts = corpus.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return materialize(texts.mapInArrow(count, "item_id long, length long, terms array<int>, times array<int>"), "item-terms")


class KeywordGroup:
    """A group of queries: their ids, their terms by place in the vocabulary, and how rare each term is."""

    def __init__(self, rows: pa.Table, vocabulary: pa.Array, idf: np.ndarray, mean: float, k1: float, b: float, block: int):
        self.ids, self.idf, self.mean, self.k1, self.b, self.block = rows["query_id"].to_numpy(), idf, mean or 1.0, k1, b, block
        every = rows["terms"].combine_chunks()
        codes = pc.index_in(every.flatten(), value_set=vocabulary).to_numpy()
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(every).to_numpy())])
        self.asked = [np.sort(codes[a:z]) for a, z in zip(edges, edges[1:])]  # sums don't depend on the order of words
        self.used = np.zeros(len(vocabulary), bool)
        self.used[codes] = True

    def blocks(self, batches, bars, rows):
        """Scores of the queries (``rows``: only these) with each block; a query skips a block below its bar."""
        number = 0
        for batch in batches:
            for i in range(0, batch.num_rows, self.block):
                number += 1
                inverted = Inverted(self, batch.slice(i, self.block))
                some = np.arange(len(self.ids)) if rows is None else rows
                if bars is not None:
                    reach = np.array([(self.idf[t] * inverted.most[t]).sum() for t in (self.asked[q] for q in some)])
                    some = some[(reach >= bars()[some]) & (reach > 0)]
                for j in range(0, len(some), CHUNK):
                    part = some[j : j + CHUNK]
                    yield part, inverted.scores(part), inverted.ids

    def leading(self, batches, bars):
        return self.blocks(batches, bars, None)


class Inverted:
    """A block of items by term: weights, and the greatest of each term."""

    def __init__(self, group: KeywordGroup, batch: pa.RecordBatch):
        self.group, self.ids = group, batch.column(0).to_numpy()
        sizes = pc.list_value_length(batch.column(2)).to_numpy()
        code = batch.column(2).flatten().to_numpy()
        kept = group.used[code]
        item, code, times = np.repeat(np.arange(len(sizes)), sizes)[kept], code[kept], batch.column(3).flatten().to_numpy()[kept]
        relative = batch.column(1).to_numpy()[item] / group.mean
        weight = times * (group.k1 + 1) / (times + group.k1 * (1 - group.b + group.b * relative))
        order = np.argsort(code, kind="stable")
        self.item, self.weight = item[order], weight[order]
        self.edges = np.searchsorted(code[order], np.arange(len(group.idf) + 1))
        self.most = np.zeros(len(group.idf))
        np.maximum.at(self.most, code, weight)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The scores of some queries with all items; minus infinity where they share no term."""
        out = np.zeros((len(rows), len(self.ids)))
        for own, q in zip(out, rows):
            for t in self.group.asked[q]:
                span = slice(self.edges[t], self.edges[t + 1])
                own[self.item[span]] += self.group.idf[t] * self.weight[span]
        out = np.round(out, DIGITS)
        return np.where(out > 0, out, -np.inf)


class Postings(Searched):
    """A corpus of texts ``item_id, text`` that a part of the queries (``query_id, terms``) searches."""

    def __init__(self, asked: DataFrame, corpus: DataFrame, k1: float = 1.2, b: float = 0.75, block: int = CORPUS_BLOCK):
        self.asked, self.k1, self.b, self.block = asked, k1, b, block
        self.vocabulary = asked.select(F.explode("terms").alias("term")).distinct().orderBy("term").toArrow()["term"].combine_chunks()
        self.items = item_terms(self.vocabulary, corpus)
        self.size = self.items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).first()
        held = self.items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(len(self.vocabulary))
        df[held["term"].to_numpy()] = held["df"].to_numpy()
        self.idf = np.log1p((self.size.n - df + 0.5) / (df + 0.5))

    def group(self, queries: pa.Table | KeywordGroup) -> KeywordGroup:
        return queries if isinstance(queries, KeywordGroup) else KeywordGroup(queries, self.vocabulary, self.idf, self.size["mean"], self.k1, self.b, self.block)

    def frame(self) -> DataFrame:
        return self.items

    def best(self, queries: pa.Table, k: int) -> DataFrame:
        """Hits of a group of queries, the best k of each task at least."""
        group = self.group(queries)
        return self.top(group, k, self.first_bars(group, k))

    def first_bars(self, queries: pa.Table | KeywordGroup, k: int) -> np.ndarray | None:
        """Per query the k-th best score among some of the items; none where that would be most of the work."""
        if self.size.n <= FIRST * self.block:
            return None
        group, some = self.group(queries), copy(self)
        some.items = self.items.where(F.pmod(F.xxhash64("item_id"), F.lit(FIRST)) == 0)
        best = top_hits(some.top(group, k), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        known = dict(zip(best["query_id"].to_pylist(), best["score"].to_pylist()))
        return np.array([known.get(q, -np.inf) for q in group.ids.tolist()])
