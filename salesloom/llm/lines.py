"""Line dedup: exact reference counts of line keys, sharded cuckoo filters before them.

A line's key is the line without white space at its ends, in ASCII lower case. The *reference
table* holds one row (key, document) for each document a key is in; inserting documents adds
rows, deleting documents removes theirs, so every decision can be undone. Counts, and the
filters over the keys that are dropped, are derived per shard: a filter shard takes inserted
keys and deletes removed ones without being rebuilt. Filtering a document asks the filters
first; only lines they let through meet the exact table.

Defined results: a null or empty text is one empty line; a key shorter than ``min_chars`` is
never dropped; a null ``doc_id`` counts as a document below all others; rows of one ``doc_id``
are one document; rows alike give rows alike; an empty table gives an empty one; columns other
than ``doc_id`` and ``text`` are not looked at (``dedup_lines`` passes them on).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm.common import ROW, fresh, row_key, store
from salesloom.llm.textscan import _SPACE, byte_values, pieces, run_hashes, signed, text_bytes

NO_DOC = -(1 << 63)  # stands for a null doc_id, below every other
SHARDS = 64
#: Up to so many dropped keys (24 bytes each) travel to the tasks whole; more are joined.
SHIPPED_KEYS = 1_000_000
#: Filters up to this size travel to the tasks before such a join.
SHIPPED_FILTER_BYTES = 64 << 20


class Lines:
    """The lines of several texts: bounds, text of each, and the two hashes of long keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int):
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
        start = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((start, text))
        self.text, self.start = text[order], start[order]
        last = np.ones(len(order), bool)
        last[:-1] = self.text[1:] != self.text[:-1]
        self.end = np.where(last, offsets[self.text + 1], np.append(self.start[1:], 0) - 1)
        self.count = np.bincount(self.text, minlength=n)
        solid = np.flatnonzero(~_SPACE[data])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = a < b
        key_start, key_end = self.start.copy(), self.start.copy()
        key_start[some], key_end[some] = solid[a[some]], solid[b[some] - 1] + 1
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        self.long = np.flatnonzero(chars[key_end] - chars[key_start] >= min_chars)
        s, e = key_start[self.long], key_end[self.long]
        self.k1 = signed(run_hashes(data, s, e, 0, byte_values(2, True)))
        self.k2 = signed(run_hashes(data, s, e, 1, byte_values(3, True)))


def line_refs(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """The reference rows (k1, k2, doc) of documents: each key once for each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).fill_null(NO_DOC).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                found = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_chars)
                text = found.text[found.long]
                order = np.lexsort((found.k2, found.k1, text))
                k1, k2, text = found.k1[order], found.k2[order], text[order]
                new = np.ones(len(k1), bool)
                new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(k1[new]), pa.array(k2[new]), pa.array(ids[i:j][text[new]])], ["k1", "k2", "doc"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "k1 long, k2 long, doc long")


def insert_refs(refs: DataFrame | None, docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """The reference table after inserting documents; inserting one again changes nothing."""
    new = line_refs(docs, min_chars)
    return (new if refs is None else refs.unionByName(new)).distinct()


def delete_refs(refs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The reference table after deleting documents (a table with ``doc_id``): as if never inserted."""
    gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc")).distinct()
    return refs.join(gone, "doc", "left_anti").select("k1", "k2", "doc")


def dropped_keys(refs: DataFrame, min_docs: int = 5) -> DataFrame:
    """Keys in at least ``min_docs`` documents, how many, and the largest document, which keeps its lines."""
    counts = refs.groupBy("k1", "k2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper"))
    return counts.where(F.col("n_docs") >= min_docs)


class Cuckoo:
    """A cuckoo filter: 16-bit fingerprints, four to a bucket, two buckets a key; deletions allowed."""

    SLOTS, KICKS = 4, 500

    def __init__(self, n_keys: int = 0, cells: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / (self.SLOTS * 0.8)))))
        self.cells = np.zeros((buckets, self.SLOTS), np.uint16) if cells is None else cells
        self.mask = len(self.cells) - 1

    @staticmethod
    def load(blob: bytes) -> Cuckoo:
        return Cuckoo(cells=np.frombuffer(blob, np.uint16).reshape(-1, Cuckoo.SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def places(self, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of each key (given by its second hash)."""
        bits = k2.view(np.uint64)
        mark = (bits >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        one = (bits & np.uint64(0xFFFFFFFF)).astype(np.int64) & self.mask
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def has(self, k2: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(k2)
        mark = mark[:, None]
        return (self.cells[one] == mark).any(1) | (self.cells[two] == mark).any(1)

    def insert(self, k2: np.ndarray) -> bool:
        """Add keys; False when the filter is too full, so that it must be built larger."""
        for mark, one, two in zip(*(x.tolist() for x in self.places(k2))):
            bucket = one if (self.cells[one] == 0).any() else two
            for kick in range(self.KICKS):
                free = np.flatnonzero(self.cells[bucket] == 0)
                if len(free):
                    self.cells[bucket, free[0]] = mark
                    break
                slot = (mark + kick) % self.SLOTS
                mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
                bucket = self.other(bucket, mark)
            else:
                return False
        return True

    def delete(self, k2: np.ndarray) -> None:
        """Remove keys that were inserted."""
        for mark, one, two in zip(*(x.tolist() for x in self.places(k2))):
            for bucket in (one, two):
                found = np.flatnonzero(self.cells[bucket] == mark)
                if len(found):
                    self.cells[bucket, found[0]] = 0
                    break


def _built(k2: np.ndarray) -> Cuckoo:
    size = max(1, len(k2))
    while True:
        made = Cuckoo(size)
        if made.insert(k2):
            return made
        size *= 2


def filters(keys: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, n_keys, cells): a cuckoo filter over the keys of each shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = _built(np.sort(pdf["k2"].to_numpy()))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_keys": [len(pdf)], "cells": [made.dump()]})

    sharded = keys.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k2")
    return sharded.groupBy("shard").applyInPandas(build, "shard int, n_keys long, cells binary")


def change_filters(old: DataFrame, added: DataFrame, removed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Filters after inserting ``added`` keys and deleting ``removed`` ones, shard by shard in place.

    A shard that gets too full to insert is returned with null cells and must be built anew
    from the exact table with ``filters``.
    """
    tagged = [x.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k2", F.lit(sign).alias("sign")) for x, sign in ((added, 1), (removed, -1))]

    def change(key, state: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        new, gone = (keys.loc[keys["sign"] == s, "k2"].to_numpy(np.int64) for s in (1, -1))
        made = Cuckoo.load(state["cells"].iloc[0]) if len(state) else Cuckoo(len(new))
        made.delete(gone)
        fits = made.insert(new)
        n = (int(state["n_keys"].iloc[0]) if len(state) else 0) + len(new) - len(gone)
        return pd.DataFrame({"shard": [key[0]], "n_keys": [n], "cells": [made.dump() if fits else None]})

    both = old.groupBy("shard").cogroup(tagged[0].unionByName(tagged[1]).groupBy("shard"))
    return both.applyInPandas(change, "shard int, n_keys long, cells binary")


def _kept(lines: Lines, data: np.ndarray, drop: np.ndarray, n_texts: int) -> tuple[np.ndarray, list[bytes | None]]:
    """Lines dropped of each text, and the kept bytes of the texts that lose any (else None)."""
    dropped = np.bincount(lines.text[drop], minlength=n_texts)
    kept: list[bytes | None] = [None] * n_texts
    first = np.cumsum(lines.count) - lines.count
    for t in np.flatnonzero(dropped).tolist():
        own = range(first[t], first[t] + lines.count[t])
        kept[t] = b"\n".join(data[lines.start[x] : lines.end[x]].tobytes() for x in own if not drop[x])
    return dropped, kept


def _shipped(keys: DataFrame, spark: SparkSession):
    """Small exact table and filters for the tasks: sorted hashes, second hashes and keepers."""
    found = keys.select("k1", "k2", "keeper").toArrow()
    k1, k2, keeper = (found.column(c).to_numpy() for c in ("k1", "k2", "keeper"))
    order = np.lexsort((k2, k1))
    marks = {row.shard: row.cells for row in filters(keys).collect()}
    return spark.sparkContext.broadcast((k1[order], k2[order], keeper[order], {s: bytes(c) for s, c in marks.items()}))


def _through(marks: dict[int, bytes], shards: int, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Which keys the filter of their shard lets through."""
    through, shard = np.zeros(len(k1), bool), k1 % shards
    for s in np.unique(shard).tolist():
        if s in marks:
            here = np.flatnonzero(shard == s)
            through[here] = Cuckoo.load(marks[s]).has(k2[here])
    return through


def _pair_keys(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return (k1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ k2.view(np.uint64)


def _clean(docs: DataFrame, keys: DataFrame, min_chars: int, shipped_keys: int, emit, schema: str) -> DataFrame:
    """Run ``emit(batch, row, lines, data, drop)`` over documents with the lines to drop marked.

    ``keys`` is stored. Small tables travel to the tasks; beyond ``shipped_keys`` the lines that
    the filters let through are joined with the exact table and come back as line numbers.
    """
    spark = docs.sparkSession
    if keys.limit(shipped_keys + 1).count() <= shipped_keys:
        sent = _shipped(keys, spark)

        def scan(batches):
            t1, t2, keeper, marks = sent.value
            pairs = _pair_keys(t1, t2)
            order = np.argsort(pairs, kind="stable")
            pairs, t1, t2, keeper = pairs[order], t1[order], t2[order], keeper[order]
            for batch in batches:
                data, offsets = text_bytes(batch.column("text"))
                ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_DOC).to_numpy(zero_copy_only=False)
                for i, j in pieces(offsets):
                    part = data[offsets[i] : offsets[j]]
                    found = Lines(part, offsets[i : j + 1] - offsets[i], min_chars)
                    drop = np.zeros(len(found.text), bool)
                    if len(pairs) and len(found.long):
                        maybe = np.flatnonzero(_through(marks, SHARDS, found.k1, found.k2))
                        k1, k2 = found.k1[maybe], found.k2[maybe]
                        at = np.minimum(np.searchsorted(pairs, _pair_keys(k1, k2)), len(pairs) - 1)
                        owner = ids[i:j][found.text[found.long[maybe]]]
                        drop[found.long[maybe]] = (t1[at] == k1) & (t2[at] == k2) & (keeper[at] != owner)
                    yield from emit(batch.slice(i, j - i), found, part, drop)

        return docs.mapInArrow(scan, schema)

    key, numbered = fresh(docs, ROW), fresh(docs, "_llm_lines")
    keyed = docs.withColumn(key, row_key())
    marks = filters(keys)
    size = marks.agg(F.sum(F.length("cells"))).first()[0] or 0
    sent = spark.sparkContext.broadcast({r.shard: bytes(r.cells) for r in marks.collect()} if size <= SHIPPED_FILTER_BYTES else None)

    def candidates(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).fill_null(NO_DOC).to_numpy(zero_copy_only=False)
            rows = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                found = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_chars)
                maybe = np.arange(len(found.long))
                if sent.value is not None:
                    maybe = np.flatnonzero(_through(sent.value, SHARDS, found.k1, found.k2))
                line = found.long[maybe]
                number = line - (np.cumsum(found.count) - found.count)[found.text[line]]
                columns = [found.k1[maybe], found.k2[maybe], ids[i:j][found.text[line]], rows[i:j][found.text[line]], number.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k1", "k2", "doc", ROW, "line"])

    asked = keyed.select(F.col("doc_id").cast("long"), "text", F.col(key).alias(ROW)).mapInArrow(candidates, f"k1 long, k2 long, doc long, {ROW} long, line int")
    hits = asked.join(keys, ["k1", "k2"]).where("doc <> keeper").groupBy(F.col(ROW).alias(key)).agg(F.collect_set("line").alias(numbered))
    joined = keyed.join(store(hits, "dropped-lines"), key, "left").drop(key)

    def scan_joined(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            numbers = batch.column(numbered).to_pylist()
            plain = batch.select([c for c in batch.schema.names if c != numbered])
            for i, j in pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                found = Lines(part, offsets[i : j + 1] - offsets[i], min_chars)
                first, drop = np.cumsum(found.count) - found.count, np.zeros(len(found.text), bool)
                for t, own in enumerate(numbers[i:j]):
                    if own:
                        drop[first[t] + np.array(own)] = True
                yield from emit(plain.slice(i, j - i), found, part, drop)

    return joined.mapInArrow(scan_joined, schema)


def _keys_of(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    return store(dropped_keys(line_refs(docs, min_chars), min_docs), "line-keys")


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shipped_keys: int = SHIPPED_KEYS, keys: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per row. ``keys``: from a kept reference table."""
    keys = _keys_of(docs, min_chars, min_docs) if keys is None else keys

    def emit(batch, lines, data, drop):
        dropped, kept = _kept(lines, data, drop, batch.num_rows)
        sizes = text_bytes(batch.column("text"))[1]
        digest = [hashlib.sha256(k if k is not None else data[sizes[t] : sizes[t + 1]]).hexdigest() for t, k in enumerate(kept)]
        columns = [batch.column("doc_id"), pa.array(lines.count), pa.array(dropped), pa.array(digest)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _clean(slim, keys, min_chars, shipped_keys, emit, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shipped_keys: int = SHIPPED_KEYS, keys: DataFrame | None = None) -> DataFrame:
    """The documents without their repeated lines, all columns kept; ``n_chars``, if there, is counted anew.

    A text that loses nothing stays as it is (a null one too); one that loses all becomes empty.
    """
    keys = _keys_of(docs, min_chars, min_docs) if keys is None else keys

    def emit(batch, lines, data, drop):
        _, kept = _kept(lines, data, drop, batch.num_rows)
        if any(k is not None for k in kept):
            texts = [t if k is None else k.decode() for t, k in zip(batch.column("text").to_pylist(), kept)]
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))
        yield batch

    cleaned = _clean(docs, keys, min_chars, shipped_keys, emit, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(kind))
    return cleaned
