"""What the searches share: groups of queries, the best k so far, and ranks counted block by block.

Queries go to the tasks in groups of known size; items stay where they are and are scored in
blocks. A task returns its best k per query, or counts, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesloom.session import materialize

QUERY_BLOCK = 16_384  # queries that are sent to the tasks at a time
CORPUS_BLOCK = 4_096  # items that are scored at a time
CHUNK = 256  # queries whose scores with a block are held at a time
DIGITS = 6  # scores are compared after rounding, then by id, so equal copies rank the same everywhere
MARGIN = 2 * 10.0**-DIGITS  # what rounding may add to a score, on both sides of a comparison
HIT_SCHEMA = "query_id bigint, item_id bigint, score double"
LAST = np.iinfo(np.int64).max


def ship(spark: SparkSession, value) -> Broadcast:
    """Send a value of known size to all tasks, with its class, which the executors need not have."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpack(sent: Broadcast):
    return cloudpickle.loads(sent.value)


def groups(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[pa.Table]:
    """The queries, about ``size`` rows at a time."""
    table = materialize(queries.withColumn("_row", F.monotonically_increasing_id()), "queries")
    n = max(1, math.ceil(table.count() / size))
    for g in range(n):
        rows = table if n == 1 else table.where(F.pmod(F.xxhash64("_row"), F.lit(n)) == g)
        yield rows.drop("_row").toArrow().combine_chunks()


def union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """Best k per query by score, then id, with ``rank`` from 1."""
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


class Leaders:
    """The k best items of each query so far, by score, then id; places not taken yet score minus infinity."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), LAST)

    def bars(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (one row each) with a block's items; minus infinity and NaN stay out."""
        k, m = self.scores.shape[1], scores.shape[1]
        scores = np.where(np.isnan(scores), -np.inf, scores)
        bar = self.scores[rows, -1]
        if m > k:
            bar = np.maximum(bar, np.partition(scores, m - k, axis=1)[:, m - k])
        row, at = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        own = np.repeat(np.arange(len(rows)), k)
        row, found, ids = np.concatenate([row, own]), np.concatenate([scores[row, at], self.scores[rows].ravel()]), np.concatenate([ids[at], self.ids[rows].ravel()])
        order = np.lexsort((ids, -found, row))
        row, found, ids = row[order], found[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        self.scores[rows[row[kept]], place[kept]], self.ids[rows[row[kept]], place[kept]] = found[kept], ids[kept]

    def hits(self, query_ids: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(self.scores > -np.inf)
        return hits(query_ids[row], self.ids[row, place], self.scores[row, place])


def hits(queries: np.ndarray, items: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(queries, pa.int64()), pa.array(items, pa.int64()), pa.array(scores, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "item_id", "score"])


class Wanted:
    """Pairs of a query (its place in the group) and an item; with scores, how many items come before each."""

    def __init__(self, query_ids: np.ndarray, pairs: pa.Table):
        place = {q: i for i, q in enumerate(query_ids.tolist())}
        known = [i for i, q in enumerate(pairs["query_id"].to_pylist()) if q in place]
        pairs = pairs.take(pa.array(known, pa.int64()))
        self.query_ids = query_ids
        self.query = np.array([place[q] for q in pairs["query_id"].to_pylist()], np.int64)
        self.item, self.score = pairs["item_id"].to_numpy(), pairs["score"].to_numpy()
        order = np.argsort(self.query, kind="stable")
        self.query, self.item, self.score = self.query[order], self.item[order], self.score[order]
        self.found, self.before = np.full(len(self.query), np.nan), np.zeros(len(self.query))

    def rows(self) -> np.ndarray:
        return np.unique(self.query)

    def read(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Note the scores of wanted items that are in a block."""
        order = np.argsort(ids, kind="stable")
        low, high = np.searchsorted(self.query, rows[0]), np.searchsorted(self.query, rows[-1], "right")
        at = np.minimum(np.searchsorted(ids[order], self.item[low:high]), len(ids) - 1)
        here = ids[order][at] == self.item[low:high]
        value = scores[np.searchsorted(rows, self.query[low:high]), order[at]]
        self.found[low:high][here] = value[here]

    def count(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Count the items of a block that come before each wanted one."""
        for row, own in zip(rows, scores):
            low, high = np.searchsorted(self.query, (row, row + 1))
            score, item = self.score[low:high, None], self.item[low:high, None]
            self.before[low:high] += ((own > score) | ((own == score) & (ids < item))).sum(1)

    def scores(self) -> pa.RecordBatch:
        some = np.isfinite(self.found)
        return hits(self.query_ids[self.query[some]], self.item[some], self.found[some])

    def counts(self) -> pa.RecordBatch:
        return hits(self.query_ids[self.query], self.item, self.before)


#: Yields the scores of some of the queries (their places, a row each) with the items of one block.
Blocks = Callable[[Iterator[pa.RecordBatch], Callable[[], np.ndarray], np.ndarray | None], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


class Searched:
    """A corpus that is searched by one group of queries after the other."""

    def group(self, queries):
        """What the tasks need of a group of queries: ``ids``, ``blocks`` to score the items of batches, and ``leading`` for those that reach their bars.
        A group that was made before stays as it is."""
        raise NotImplementedError

    def frame(self) -> DataFrame:
        """The items, as the group's ``blocks`` reads them."""
        raise NotImplementedError

    def top(self, queries, k: int, bars: np.ndarray | None = None) -> DataFrame:
        """The best k of each task; with ``bars`` what is below its query's bar may be left out."""
        sent = ship(self.frame().sparkSession, (self.group(queries), bars))

        def search(batches):
            group, known = unpack(sent)
            leaders = Leaders(len(group.ids), k)
            floor = np.full(len(group.ids), -np.inf) if known is None else known
            for rows, scores, ids in group.leading(batches, lambda: np.maximum(floor, leaders.bars()) - MARGIN):
                leaders.offer(rows, scores, ids)
            yield leaders.hits(group.ids)

        return self.frame().mapInArrow(search, HIT_SCHEMA)

    def ranks(self, queries: pa.Table, pairs: pa.Table) -> DataFrame:
        """``query_id, item_id, rank`` of given pairs (``query_id, item_id, score``: null where it is not known) in the whole corpus.

        Pairs without a score have none in this corpus when it is not found, and no rank.
        """
        frame, group = self.frame(), self.group(queries)
        scored = pairs.filter(pa.compute.is_valid(pairs["score"]))
        open_pairs = Wanted(group.ids, pairs.filter(pa.compute.is_null(pairs["score"])))
        if len(open_pairs.query):
            sent = ship(frame.sparkSession, (group, open_pairs))

            def read(batches):
                own, wanted = unpack(sent)
                for rows, scores, ids in own.blocks(batches, None, wanted.rows()):
                    wanted.read(rows, scores, ids)
                yield wanted.scores()

            scored = pa.concat_tables([scored, frame.mapInArrow(read, HIT_SCHEMA).toArrow()])
        counted = ship(frame.sparkSession, (group, Wanted(group.ids, scored.combine_chunks())))

        def count(batches):
            own, wanted = unpack(counted)
            for rows, scores, ids in own.blocks(batches, None, wanted.rows()):
                wanted.count(rows, scores, ids)
            yield wanted.counts()

        before = frame.mapInArrow(count, HIT_SCHEMA)
        return before.groupBy("query_id", "item_id").agg((F.sum("score") + 1).cast("int").alias("rank"))
