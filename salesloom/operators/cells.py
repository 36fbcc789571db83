"""Vector search by cosine over learned cells: exact with a proven bound, or approximate with a learned one.

Centroids come from spherical k-means over a sample of at most about ``SAMPLE`` vectors; every vector is
then placed in the cell of its nearest centroid, and the vectors are written in the order of their cells, a
big cell over many partitions. A task reads them in blocks of one cell. By the triangle inequality of
angles no vector of a block is nearer to a query than the query's angle to the centroid less the
block's widest one. A first round searches each query's nearest cells; the k-th best cosine found is its bar,
and in the second round a block meets only the queries whose bound reaches their bar. Where they meet,
single precision finds what may reach the bar, and double precision its score.

The approximate search replaces the bound by an estimate: what the block's mean angle gives if a
share ``slack`` of the rest points the query's way. The slack is learned: about ``CALIBRATE`` of the queries
are searched exactly, and it is the value that would have let ``RECALL`` of their neighbours be found,
those in the nearest cells and those in cells that pass. Scores are exact in both.

A corpus of fewer than two cells' vectors is searched as it lies. Null and zero vectors, and those with
values that are null or not finite, are never found and find nothing.
"""

from __future__ import annotations

import math
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.operators.search import CHUNK, CORPUS_BLOCK, DIGITS, HIT_SCHEMA, MARGIN, Searched, ship, top_hits, unpack
from salesloom.session import materialize

SAMPLE = 20_000
CELL = 2_048  # vectors of a cell, on average
MOST_CELLS = 4_096
ROUNDS = 8
NEAREST = 2  # cells of the first round
CALIBRATE, RECALL = 256, 0.95
SEED = 11
ROWS = 1_024  # vectors whose cosines with all centroids are held at a time


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column that have a direction, at length one, and their places."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    rows = np.flatnonzero(sizes > 0)
    if not len(rows):
        return np.empty((0, 0)), rows
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), -1)
    norm = np.linalg.norm(matrix, axis=1)
    usable = np.isfinite(norm) & (norm > 0)
    return matrix[usable] / norm[usable, None], rows[usable]


def nearest_cells(vectors: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector and its cosine with the centroid, some rows at a time."""
    cell, best = np.empty(len(vectors), np.int64), np.empty(len(vectors))
    for i in range(0, len(vectors), ROWS):
        near = vectors[i : i + ROWS] @ centers.T
        cell[i : i + ROWS], best[i : i + ROWS] = near.argmax(1), near.max(1)
    return cell, best


def learn_cells(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means: unit centroids; a cell that runs empty takes the vector farthest from its own."""
    rng = np.random.default_rng(SEED)
    centers = sample[np.sort(rng.choice(len(sample), min(n, len(sample)), replace=False))].copy()
    for _ in range(ROUNDS):
        own, best = nearest_cells(sample, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centers)) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return centers


class VectorGroup:
    """A group of queries, and with centroids which cells are nearest to each."""

    def __init__(self, queries: pa.Table, centers: np.ndarray | None, slack: float | None, block: int):
        self.units, rows = units(queries["vector"])
        self.ids = queries["query_id"].to_numpy()[rows]
        self.slack, self.block, self.only_near = slack, block, False
        self.centers, self.near = None, None
        if centers is not None and len(self.ids):
            self.centers = centers
            parts = (self.units[i : i + ROWS] @ centers.T for i in range(0, len(self.ids), ROWS))
            self.near = np.concatenate([np.argpartition(-part, NEAREST - 1, axis=1)[:, :NEAREST] for part in parts])

    def angle(self, cell: int) -> np.ndarray:
        """Of each query to a cell's centroid; only one cell's angles are held at a time."""
        return np.arccos(np.clip(self.units @ self.centers[cell], -1, 1))

    def is_near(self, cell: int) -> np.ndarray:
        return (self.near == cell).any(axis=1)

    def reach(self, cell: int, widths: np.ndarray) -> np.ndarray:
        """No cosine of a query with a block of this cell is above it (with a slack: few are)."""
        angle = self.angle(cell)
        bound = np.cos(np.maximum(0, angle - widths.max()))
        if self.slack is None:
            return bound
        mean = widths.mean()
        return np.minimum(bound, np.cos(angle) * np.cos(mean) + np.sin(angle) * np.sin(mean) * self.slack)

    def cuts(self, batch: pa.RecordBatch):
        """Blocks of one cell: first and last row, and the cell."""
        if self.centers is None or "cell" not in batch.schema.names:
            for a in range(0, batch.num_rows, self.block):
                yield a, min(batch.num_rows, a + self.block), None
            return
        cell = batch.column(2).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        for low, high in zip(edges, edges[1:]):
            for a in range(low, high, self.block):
                yield a, min(high, a + self.block), int(cell[a])

    def met(self, batches, bars, rows):
        """Each block with the queries (their places) that must meet it: the queries, the block's units and ids."""
        if not len(self.ids):
            return
        for batch in batches:
            for a, b, cell in self.cuts(batch):
                some = np.arange(len(self.ids)) if rows is None else rows
                if cell is not None and self.only_near:
                    some = some[self.is_near(cell)[some]]
                elif cell is not None and bars is not None:
                    passes = self.reach(cell, batch.column(3).to_numpy()[a:b]) >= bars()
                    if self.slack is not None:
                        passes |= self.is_near(cell)
                    some = some[passes[some]]
                if not len(some):
                    continue
                matrix, usable = units(batch.column(1).slice(a, b - a))
                if len(usable):
                    yield some, matrix, batch.column(0).to_numpy()[a:b][usable]

    def blocks(self, batches, bars, rows):
        for some, matrix, ids in self.met(batches, bars, rows):
            for j in range(0, len(some), CHUNK):
                part = some[j : j + CHUNK]
                yield part, np.round(self.units[part] @ matrix.T, DIGITS), ids

    def leading(self, batches, bars):
        """The same without what is below its query's bar: cosines in single precision, less what they may err by,
        tell which queries and items may reach it; only between these is a score worked out in double precision."""
        single = self.units.astype(np.float32)
        error = (single.shape[1] + 8) * float(np.finfo(np.float32).eps) if len(self.ids) else 0.0
        for some, matrix, ids in self.met(batches, bars, None):
            rough, bar = matrix.astype(np.float32).T, (bars() - error).astype(np.float32)
            for j in range(0, len(some), CHUNK):
                part = some[j : j + CHUNK]
                reached = single[part] @ rough >= np.nextafter(bar[part], np.float32(-np.inf))[:, None]
                own = reached.any(axis=1)
                if own.any():
                    items = np.flatnonzero(reached[own].any(axis=0))
                    yield part[own], np.round(self.units[part[own]] @ matrix[items].T, DIGITS), ids[items]


class Cells(Searched):
    """A corpus of vectors ``item_id, vector``; ``cells``: how many (one: as it lies), else by its size."""

    def __init__(self, corpus: DataFrame, cells: int | None = None, per_cell: float = CELL, block: int = CORPUS_BLOCK):
        corpus = corpus.where("vector IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "vector")
        self.items, self.centers, self.slack, self.block = corpus, None, None, block
        n = corpus.count()
        self.n, cells = n, min(MOST_CELLS, int(n / per_cell)) if cells is None else cells
        if cells >= 2:
            parts = max(1, math.ceil(n / SAMPLE))
            drawn = corpus.where(F.pmod(F.xxhash64("item_id", F.lit("sample")), F.lit(parts)) == 0).orderBy("item_id").select("vector")
            sample, _ = units(drawn.toArrow()["vector"])
            if len(sample) >= cells:
                self.centers = learn_cells(sample, cells)
                self.items = self._placed(corpus)

    def _placed(self, corpus: DataFrame) -> DataFrame:
        sent = ship(corpus.sparkSession, self.centers)

        def place(batches):
            centers = unpack(sent)
            for batch in batches:
                matrix, usable = units(batch.column(1))
                if len(usable):
                    cell, best = nearest_cells(matrix, centers)
                    width = np.arccos(np.clip(best, -1, 1))
                    kept = batch.take(pa.array(usable))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(cell.astype(np.int32)), pa.array(width)], ["item_id", "vector", "cell", "width"])

        kind = corpus.schema["vector"].dataType.simpleString()
        rows = corpus.mapInArrow(place, f"item_id long, vector {kind}, cell int, width double")
        order = ["cell", "width", "item_id"]  # a part of a cell holds vectors about as far from the centroid
        return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order), "cells")

    def frame(self) -> DataFrame:
        return self.items

    def group(self, queries: pa.Table | VectorGroup) -> VectorGroup:
        return queries if isinstance(queries, VectorGroup) else VectorGroup(queries, self.centers, self.slack, self.block)

    def like(self, **changed) -> Cells:
        other = copy(self)
        vars(other).update(changed)
        return other

    def first_bars(self, queries: pa.Table | VectorGroup, k: int) -> np.ndarray | None:
        """Per query the k-th best cosine in its nearest cells."""
        if self.centers is None:
            return None
        group = self.group(queries)
        near = copy(group)
        near.only_near = True
        best = top_hits(self.top(near, k), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        known = dict(zip(best["query_id"].to_pylist(), best["score"].to_pylist()))
        return np.array([known.get(q, -np.inf) for q in group.ids.tolist()])

    def nearest(self, queries: pa.Table, k: int) -> DataFrame:
        """Hits of a group of queries, the best k of each task at least."""
        group = self.group(queries)
        return self.top(group, k, self.first_bars(group, k))

    def calibrated(self, queries: pa.Table, k: int, recall: float = RECALL) -> Cells:
        """The same cells with the slack that would have found ``recall`` of these queries' neighbours."""
        if self.centers is None:
            return self
        found = top_hits(self.nearest(queries, k), k).select("query_id", "item_id", "score")
        own = self.items.select("item_id", "cell").join(F.broadcast(found), "item_id").toArrow()  # k rows a calibrating query
        means = self.items.groupBy("cell").agg(F.avg("width").alias("mean")).toArrow()
        mean = dict(zip(means["cell"].to_pylist(), means["mean"].to_pylist()))
        group = self.group(queries)
        place = {q: i for i, q in enumerate(group.ids.tolist())}
        row = np.array([place[q] for q in own["query_id"].to_pylist()], np.int64)
        cell = own["cell"].to_numpy()
        angle = np.arccos(np.clip((group.units[row] * self.centers[cell]).sum(1), -1, 1))
        width = np.array([mean[c] for c in cell.tolist()])
        room = np.maximum(np.sin(angle) * np.sin(width), 1e-9)
        needed = (own["score"].to_numpy() - np.cos(angle) * np.cos(width)) / room
        beyond = needed[(group.near[row] != cell[:, None]).all(1)]  # the nearest cells are searched anyway
        if not len(beyond):
            return self.like(slack=None if not len(needed) else float(needed.min()))
        missed = min(1.0, (1 - recall) * len(needed) / len(beyond))
        return self.like(slack=float(np.quantile(beyond, 1 - missed)))

    def pairs(self, queries: pa.Table, k: int) -> DataFrame:
        """How many pairs of a query and an item the search scores: ``scored``, a row each task."""
        own = self.group(queries)
        sent = ship(self.items.sparkSession, (own, self.first_bars(own, k)))

        def count(batches):
            group, bars = unpack(sent)
            known = None if bars is None else lambda: bars - MARGIN
            total = sum(scores.size for _, scores, _ in group.blocks(batches, known, None))
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([float(total)])], ["query_id", "item_id", "score"])

        return self.items.mapInArrow(count, HIT_SCHEMA).agg(F.coalesce(F.sum("score"), F.lit(0.0)).cast("long").alias("scored"))
