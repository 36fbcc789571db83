"""Ranked lexical search of all documents for a table of items, by hashed max-sketches.

One pass over the texts keeps, per document, its number of terms and how often it has each term
that some item asks for; numbers of documents, terms and holders of a term are sums over that
table. A term's *impact* in a document is what one occurrence in an item adds to the score. Each
document's impacts fold into a sketch of ``WIDTH`` coordinates: a term belongs to the coordinate
of its hash, a coordinate holds the greatest impact that falls on it. The sum of an item's
coordinates, repeats counted, is never below the score.

A task takes documents in blocks and items in batches. It looks up the bounds of a batch for a
whole block, and per item rescores documents exactly in descending order of bounds, until the
bound falls below the lowest of the best scores so far; these carry over to the next block. Tasks
return their best ``k`` per item, which Spark ranks. All arithmetic is in whole numbers.

Items are asked in groups of about ``GROUP``, so a task holds a group's terms and best
scores, however many items there are; a group's terms are sent to all tasks (at most
``GROUP`` texts). Texts are read once for each group.

Defined results: a null or termless document matches nothing and counts neither in N nor in L; a
null or termless item has no rows; each row is an item or a document of its own, so alike items get
alike lists and repeated documents are listed each; equal scores go by doc_id, a null id last;
empty tables give no rows; other columns are not looked at. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import ship, store, unpack
from salesloom.llm.textscan import Words, mix, pieces, text_bytes

BEST = 10
WIDTH = 1024
GROUP = 4096
BLOCK = 4096  # documents
RESCORED = 64  # documents rescored at a time
NO_ID = np.iinfo(np.int64).max


class Items:
    """A group of items: their ids, the terms some of them asks for, ascending, and each one's terms with repeats."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [r[0] for r in rows]
        data, offsets = text_bytes(pa.array([r[1] for r in rows], pa.string()))
        words = Words(data, offsets, "alnum", lower=True)
        self.terms = np.unique(words.hashes)
        at, of = np.searchsorted(self.terms, words.hashes), words.text_of()
        self.asked = []  # (term, times) of each item
        for i in range(len(rows)):
            self.asked.append(np.unique(at[of == i], return_counts=True))


def read_terms(batch: pa.Array, terms: np.ndarray):
    """Of each text, in pieces: how many terms it has, and the places in ``terms`` of those asked for, with their numbers."""
    data, offsets = text_bytes(batch)
    for a, b in pieces(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], "alnum", lower=True)
        at = np.minimum(np.searchsorted(terms, words.hashes), max(0, len(terms) - 1))
        hit = terms[at] == words.hashes if len(terms) else np.zeros(len(at), bool)
        pair, times = np.unique(words.text_of()[hit] * (len(terms) + 1) + at[hit], return_counts=True)
        text, term = np.divmod(pair, len(terms) + 1)
        yield a, b, words.counts, np.searchsorted(text, np.arange(b - a + 1)), term, times


class Block:
    """Documents with their impacts, term by term, and their sketches."""

    def __init__(self, ids: np.ndarray, edges: np.ndarray, term: np.ndarray, impact: np.ndarray, place: np.ndarray):
        self.ids, self.edges, self.term, self.impact = ids, edges, term, impact
        self.sketch = np.zeros((WIDTH, len(ids)), np.int64)
        of = np.repeat(np.arange(len(ids)), np.diff(edges))
        np.maximum.at(self.sketch, (place[term], of), impact)

    def bounds(self, places: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The upper bound of each document for an item with so many terms at these coordinates."""
        total = np.zeros(len(self.ids), np.int64)
        for at, n in zip(places, times):
            total += n * self.sketch[at]
        return total

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The exact scores of some documents; ``weight`` has how often the item asks for each term."""
        sizes = self.edges[docs + 1] - self.edges[docs]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.edges[docs] - starts[:-1], sizes) + np.arange(starts[-1])
        total = np.concatenate([[0], np.cumsum(self.impact[at] * weight[self.term[at]])])
        return total[starts[1:]] - total[starts[:-1]]


class Best:
    """The best scores of an item so far: greatest first, then by id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def bar(self) -> int:
        """A bound below it can't enter; one equal to it can, by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores[scores > 0]]), np.concatenate([self.ids, ids[scores > 0]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def search(self, block: Block, bounds: np.ndarray, weight: np.ndarray) -> int:
        """Rescore in descending order of bounds until they fall below the bar; how many were."""
        open_docs = np.flatnonzero(bounds >= self.bar())
        order, done = open_docs[np.argsort(-bounds[open_docs], kind="stable")], 0
        while done < len(order) and bounds[order[done]] >= self.bar():
            docs = order[done : done + RESCORED]
            self.add(block.scores(docs, weight), block.ids[docs])
            done += len(docs)
        return done


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score. See the module text."""
    asked = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    asked = store(asked.withColumn("_row", F.monotonically_increasing_id()), "search-items")
    groups = max(1, math.ceil(asked.count() / GROUP))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = None
    for g in range(groups):  # GROUP items at a time
        rows = asked.where(F.pmod(F.xxhash64("_row"), F.lit(groups)) == g).orderBy("item_id", "_row").collect()
        found = _hits(texts, Items([(r.item_id, r.text) for r in rows]), g, k)
        hits = found if hits is None else hits.unionByName(found)
    best = Window.partitionBy("_group", "_item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("item_id", "rank", "doc_id", "score")


def _hits(texts: DataFrame, items: Items, group: int, k: int) -> DataFrame:
    """The best of each task for one group of items."""
    spark = texts.sparkSession
    sent = ship(spark, items.terms)

    def count(batches):
        terms = unpack(sent)
        for batch in batches:
            for a, b, sizes, edges, term, times in read_terms(batch.column(1), terms):
                held = [pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), *held], ["doc_id", "n", "terms", "times"])

    def holders(batches):
        total = np.zeros(len(items_terms), np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    items_terms = np.empty(len(items.terms), np.int8)  # only its length travels
    index = store(texts.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>"), "search-index").where("n > 0")
    size = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    held = index.select("terms").mapInArrow(holders, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    weight = np.zeros(len(items.terms), np.int64)
    for row in held.toLocalIterator():  # one row a term of the group
        weight[row.term] = math.floor(1000 * math.log((2 * size.n + 2) / (2 * row.n + 1)))
    plan = ship(spark, (items, weight, size.n, size.l))

    def search(batches):
        own, weights, n_docs, n_terms = unpack(plan)
        place = (mix(own.terms) % np.uint64(WIDTH)).astype(np.int64) if len(own.terms) else np.empty(0, np.int64)
        best = [Best(k) for _ in own.ids]
        asked = np.zeros(len(own.terms), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                block = _block(batch.slice(i, BLOCK), weights, n_docs, n_terms, place)
                for (term, times), top in zip(own.asked, best):
                    asked[term] = times
                    top.search(block, block.bounds(place[term], times), asked)
                    asked[term] = 0
        for i, top in enumerate(best):
            if len(top.ids):
                n = len(top.ids)
                ids = pa.array(top.ids, mask=top.ids == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * n, pa.int32()), pa.array([i] * n, pa.int32()), pa.array([own.ids[i]] * n, pa.int64()), ids, pa.array(top.scores)],
                    ["_group", "_item", "item_id", "doc_id", "score"],
                )

    return index.mapInArrow(search, "_group int, _item int, item_id long, doc_id long, score long")


def _block(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int, place: np.ndarray) -> Block:
    """The impacts of some documents of the index."""
    ids = batch.column(0).fill_null(NO_ID).to_numpy()
    n = batch.column(1).to_numpy()
    sizes = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    term, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
    share = np.array([(75 * x * n_docs) // n_terms for x in n.tolist()], np.int64)  # whole numbers of any size
    m = np.repeat(100 - 75 + share, sizes)
    impact = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m))
    return Block(ids, edges, term, impact, place)
