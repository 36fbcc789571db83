"""Embedding near-dedup: a forest of random projection trees with spill overlap.

Equal vectors form a class; classes are compared. In each of ``TREES`` trees a node's vectors
are projected on a random direction and split at the median; those in the middle share go to
both sides, so close vectors are seldom parted. Nodes above ``LEAF`` vectors are split again,
several levels a round, by directions and cuts fitted on a bounded sample of the node's own
vectors, all nodes in one job. Leaves are compared whole by matrix products: a leaf returns each
vector's number of links and a spanning forest of them, never pairs. A pair that shares several
leaves is counted in the smallest of them.

A node is not split where it is dense, that is, where ``DENSE`` of its sampled pairs or more are
linked: any cut would part many links. It is a leaf of any size, compared exactly in pairs of
parts of about ``PART`` vectors. A table that is dense itself is compared once, in no tree. The
work in a dense leaf grows with the square of its size, as its number of links does.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or infinity link with
nothing; vectors of different lengths don't link; equal rows link with each other; a null
``vec_id`` is never the smallest unless all are null; an empty table gives an empty one.
Classes are named by a 64-bit hash of the vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import if_small, store
from salesloom.llm.components import components
from salesloom.llm.textscan import mix

COSINE = 0.95
TREES, LEAF, SPILL = 8, 1024, 0.06
#: Linked share of a node's sampled pairs from which it stays whole, and vectors of a part of it.
DENSE, PART = 0.02, 4096
#: Vectors of a node that fit its splits, and levels split in one round.
SAMPLE, LEVELS = 2048, 6
#: Vectors that are routed through a node's splits together.
ROUTED = 4096
SEED = 11


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else column, np.float64)


def _jitter(cls: np.ndarray, salt: int) -> np.ndarray:
    """A tiny offset per vector, so that equal projections still split."""
    return (mix(cls.view(np.uint64) + np.uint64(salt)) >> np.uint64(40)).astype(np.float64) * (1e-9 / (1 << 24))


def _dense(x: np.ndarray, cosine: float) -> bool:
    """Whether a sample's pairs are linked so often that a cut would part many links."""
    linked = sum(int((x[a : a + 512] @ x.T >= cosine).sum()) for a in range(0, len(x), 512)) - len(x)
    return len(x) > 1 and linked >= DENSE * len(x) * (len(x) - 1)


def _fit(x: np.ndarray, cls: np.ndarray, seed: int, levels: int, cosine: float):
    """Directions and the two cuts of each inner node of a subtree, in heap order; infinite cuts where a node stays whole."""
    rng = np.random.default_rng(seed)
    normals = rng.standard_normal(((1 << levels) - 1, x.shape[1]))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    cuts = np.zeros((len(normals), 2))
    rows = {0: np.arange(len(x))}
    for node in range(len(normals)):
        own = rows.pop(node)
        if _dense(x[own], cosine):
            cuts[node] = np.inf
            own = own[:0]
            rows[2 * node + 1] = rows[2 * node + 2] = own
            continue
        value = x[own] @ normals[node] + _jitter(cls[own], node)
        cuts[node] = np.quantile(value, [0.5 - SPILL, 0.5 + SPILL]) if len(own) else 0
        middle = np.median(value) if len(own) else 0
        rows[2 * node + 1], rows[2 * node + 2] = own[value <= middle], own[value > middle]
    return normals, cuts


def _route(x: np.ndarray, cls: np.ndarray, normals: np.ndarray, cuts: np.ndarray):
    """(row, leaf, whether it is dense) of each vector's leaves: one or, near cuts, several."""
    row, node, ended = np.arange(len(x)), np.zeros(len(x), np.int64), []
    while len(node) and node[0] < len(normals):  # all rows are on one level
        whole = np.isinf(cuts[node, 0])
        ended.append((row[whole], node[whole], whole[whole]))
        row, node = row[~whole], node[~whole]
        value = np.einsum("ij,ij->i", x[row], normals[node])
        for own in np.unique(node):
            at = node == own
            value[at] += _jitter(cls[row[at]], int(own))
        left, right = value <= cuts[node, 1], value >= cuts[node, 0]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    ended.append((row, node, np.zeros(len(row), bool)))
    return tuple(np.concatenate(column) for column in zip(*ended))


def _classes(vectors: DataFrame) -> DataFrame:
    """(cls, least, size, v): the distinct usable vectors, normalised."""

    def normalise(batches):
        for batch in batches:
            column = batch.column("e")
            keep, unit = [], []
            for i, own in enumerate(column):
                v = own.values.to_numpy(zero_copy_only=False).astype(np.float64) if own.is_valid else np.empty(0)  # a null is a NaN here
                peak = np.abs(v).max() if len(v) else 0.0
                if np.isfinite(peak) and peak > 0:  # scaled first, so that squares neither overflow nor vanish
                    keep.append(i)
                    unit.append(v / peak / np.linalg.norm(v / peak))
            rest = batch.select(["cls", "least", "size"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(unit, pa.list_(pa.float64()))], ["cls", "least", "size", "v"])

    once = vectors.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    e = F.col("embedding").cast("array<double>")
    return once.select(F.xxhash64(e).alias("cls"), "least", "size", e.alias("e")).mapInArrow(normalise, "cls long, least long, size long, v array<double>")


def _drawn(size: str, *key: str):
    """Whether a row is in the sample of about ``SAMPLE`` rows of its group."""
    draw = F.pmod(F.xxhash64("cls", *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return draw < F.lit(float(SAMPLE)) / F.col(size)


def leaves(classes: DataFrame, trees: int = TREES, limit: int = LEAF, cosine: float = COSINE) -> DataFrame:
    """(cls, leaf, v): every vector in its leaves of every tree; only dense leaves hold more than ``limit``."""
    sized = classes.select("cls", "v", F.size("v").alias("d"))
    lengths = store(sized.groupBy("d").agg(F.count("*").alias("m")).where(F.col("m") > limit), "lengths")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": pdf["d"].iloc[:1], "whole": [_dense(_matrix(pdf["v"]), cosine)]})

    sample = sized.join(if_small(lengths), "d").where(_drawn("m", "d"))
    whole = store(sample.groupBy("d").applyInPandas(judge, "d int, whole boolean").where("whole"), "dense-lengths")
    start = sized.join(if_small(whole), "d", "left").withColumn("dense", F.coalesce("whole", F.lit(False)))
    start = start.withColumn("tree", F.explode(F.sequence(F.lit(1), F.when(F.col("dense"), 1).otherwise(trees))))
    start = start.select("cls", "v", F.xxhash64(F.lit("root"), "tree", "d").alias("leaf"), "dense")
    plain = ["cls", "v", "leaf"]
    done, rows, largest = [start.where("dense").select(*plain)], start.where("NOT dense").select(*plain), None
    while True:
        sizes = store(rows.groupBy("leaf").agg(F.count("*").alias("m")), "leaf-sizes")
        large = sizes.where(F.col("m") > limit)
        now = large.agg(F.max("m")).first()[0]
        if now is None:
            return _all([*done, rows])
        if largest is not None and now >= largest:
            raise RuntimeError("the forest's leaves don't get smaller")
        largest = now
        large = store(large, "large-leaves")
        sample = rows.join(if_small(large), "leaf").where(_drawn("m", "leaf"))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            x, cls = _matrix(pdf["v"]), pdf["cls"].to_numpy()
            order = np.argsort(cls)
            leaf, size = int(pdf["leaf"].iloc[0]), int(pdf["m"].iloc[0])
            levels = min(LEVELS, max(1, int(np.ceil(np.log2(size * 1.5 / limit)))), max(1, int(np.log2(len(x) / 16))) if len(x) > 32 else 1)
            normals, cuts = _fit(x[order], cls[order], abs(leaf) % (1 << 32) + SEED, levels, cosine)
            return pd.DataFrame({"leaf": [leaf], "normals": [normals.ravel().tolist()], "cuts": [cuts.ravel().tolist()]})

        splits = sample.groupBy("leaf").applyInPandas(grow, "leaf long, normals array<double>, cuts array<double>")
        splits = store(splits, "splits")

        def route(part: pa.Table, split: pa.Table) -> pa.Table:
            if not len(part):
                return part.select(plain).append_column("dense", pa.array([], pa.bool_()))
            cls, leaf = part.column("cls").to_numpy(), part.column("leaf")[0].as_py()
            x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            cuts = split.column("cuts").combine_chunks().flatten().to_numpy().reshape(-1, 2)
            normals = split.column("normals").combine_chunks().flatten().to_numpy().reshape(len(cuts), -1)
            row, node, dense = _route(x, cls, normals, cuts)
            named = mix(mix(np.full(len(node), leaf).view(np.uint64)) + node.astype(np.uint64)).view(np.int64)
            return pa.table({"cls": part.column("cls").take(pa.array(row)), "v": part.column("v").take(pa.array(row)), "leaf": pa.array(named), "dense": pa.array(dense)})

        # a node's vectors meet its splits in parts of about ROUTED, so a large node is many groups
        parts = F.ceil(F.col("m") / ROUTED).cast("int")
        salted = rows.join(if_small(large), "leaf").select("cls", "v", "leaf", F.pmod(F.xxhash64("cls"), parts).cast("int").alias("salt"))
        copies = splits.join(if_small(large), "leaf").select("leaf", "normals", "cuts", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        routed = salted.groupBy("leaf", "salt").cogroup(copies.groupBy("leaf", "salt")).applyInArrow(route, "cls long, v array<double>, leaf long, dense boolean")
        done.append(rows.join(if_small(large), "leaf", "left_anti").select(*plain))
        routed = store(routed, "routed")
        done.append(routed.where("dense").select(*plain))
        rows = routed.where("NOT dense").select(*plain)


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _spanning(near: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place of a symmetric table of links."""
    base = np.arange(len(near))
    open_ = near.any(axis=1)
    for i in np.flatnonzero(open_):
        if open_[i]:
            open_[i], front = False, np.array([i])
            while len(front):  # every place is in front once
                reached = open_.copy()
                reached &= np.any(near[front], axis=0)
                front = np.flatnonzero(reached)
                open_[front], base[front] = False, i
    return base


def _compare(cosine: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links counted here and spanning links of two parts of a leaf, or inside one, each row by its class."""
        pdf = pdf.sort_values("cls")
        x, cls, size, part = _matrix(pdf["v"]), pdf["cls"].to_numpy(), pdf["size"].to_numpy(), pdf["part"].to_numpy()
        leaf, a, b = int(pdf["leaf"].iloc[0]), int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        # which smaller leaves each vector is in as well: a pair that shares one is counted there
        at = np.repeat(np.arange(len(x)), [len(o) for o in pdf["own"]])
        others = np.concatenate(pdf["own"].tolist())
        name, column = np.unique(others[others < leaf], return_inverse=True)
        earlier = np.zeros((len(x), max(1, len(name))), np.float32)
        earlier[at[others < leaf], column] = 1
        count, near = np.zeros(len(x), np.int64), np.zeros((len(x), len(x)), bool)
        left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
        for i in range(0, len(left), 512):
            own = left[i : i + 512]
            linked = x[own] @ x[right].T >= cosine
            linked &= own[:, None] != right
            near[np.ix_(own, right)] = linked
            linked &= earlier[own] @ earlier[right].T == 0
            count[own] += linked @ size[right]
            if a != b:
                near[np.ix_(right, own)] = near[np.ix_(own, right)].T
                count[right] += size[own] @ linked
        base = _spanning(near)
        return pd.DataFrame({"cls": cls, "base": cls[base], "links": count})[(count > 0) | (base != np.arange(len(x)))]

    return compare


def near_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, limit: int = LEAF) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.xxhash64(F.col("embedding").cast("array<double>")).alias("cls"))
    classes = store(_classes(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), "classes")
    placed = store(leaves(classes.select("cls", "v"), trees, limit, cosine), "leaves")
    own = store(placed.groupBy("cls").agg(F.collect_set("leaf").alias("own")).join(classes.select("cls", "size"), "cls"), "own-leaves")
    # a leaf of many parts meets itself in pairs of parts
    large = store(placed.groupBy("leaf").agg(F.ceil(F.count("*") / max(limit, PART)).cast("int").alias("parts")).where("parts > 1"), "dense-leaves")
    parts = F.coalesce("parts", F.lit(1))
    cut = placed.join(if_small(large), "leaf", "left").select("cls", "v", "leaf", F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    pairs = cut.select("cls", "v", "leaf", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    grouped = pairs.join(own, "cls").groupBy("leaf", "a", "b")
    found = store(grouped.applyInPandas(_compare(cosine), "cls long, base long, links long"), "leaf-links")
    named = store(components(found, "cls", "base"), "components")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    counted = classes.select("cls", "least", "size").join(links, "cls", "left").join(named.withColumnRenamed("node", "cls"), "cls", "left")
    counted = store(counted.select("cls", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cls").alias("c")), "class-links")
    ids = store(counted.groupBy("c").agg(F.min("least").alias("component_id")), "component-ids")
    marks = store(counted.join(ids, "c").where("n_links > 0").select("cls", "n_links", "component_id"), "linked-classes")
    full = keyed.join(if_small(marks), "cls", "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
