"""Benchmark decontamination: a prefix-filtered set join with exact checks.

Items are cut into windows of ``width`` words (a shorter item is one window). A window is a
set of two-word shingles that must all be in a document that holds it, so the prefix the join
needs is one shingle: the rarest of the window in the corpus. Documents are scanned twice: once
to count the benchmark's shingles, once to find the places of the chosen ones. Each place
travels with the words around it to a join on the shingle; its position in the window bounds
where the window must begin and end inside the document, and the words are then compared.

Tasks know the wanted shingles by a bit table of fixed size, so nothing sent to them grows
with the benchmark; it only lets more places through, which the join then drops.

Defined results: null and empty texts have no words; an item without words has no window; an
item with a null id marks words but is not listed; repeated items count once by id; rows alike
give rows alike; an empty benchmark leaves every document clean. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import ROW, fresh, if_small, row_key, store
from salesloom.llm.textscan import Words, mix, pieces, run_hashes, signed, text_bytes

WIDTH = 10
#: Bits of the table of wanted shingles (4 MB sent to each executor).
FILTER_BITS = 22
#: Benchmarks of up to so many windows are broadcast in the join (about 200 bytes each).
BROADCAST_WINDOWS = 50_000


def _pairs(words: Words) -> np.ndarray:
    """The two-word shingle beginning at each word (with the text's last word alone at its end)."""
    n = len(words.hashes)
    at = np.arange(n)
    end = np.minimum(at + 2, words.first[1:][words.text_of()]) if n else at
    return run_hashes(words.hashes, at, end, 1)


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, wid, len, words, shingles): every window of every item; ``wid`` names its words."""

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in pieces(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "alnum", True)
                pairs, rows = _pairs(words), []
                for t, n in enumerate(words.counts.tolist()):
                    size = min(width, n)
                    for a in range(words.first[t], words.first[t] + (n - size + 1 if n else 0)):
                        own = pairs[a : a + size - 1] if size > 1 else words.hashes[a : a + 1]
                        rows.append((i + t, size, signed(words.hashes[a : a + size]), signed(own)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                        pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    ],
                    ["item_id", "len", "words", "shingles"],
                )

    found = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(scan, "item_id long, len int, words array<long>, shingles array<long>")
    return found.withColumn("wid", F.xxhash64("words", "len"))


def _bits(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(hashes: DataFrame, column: str):
    """The bit table of a column of shingles, sent to the tasks."""

    def scan(batches):
        for batch in batches:
            bits = np.unique(_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int32))], ["bit"])

    bits = hashes.select(column).mapInArrow(scan, "bit int").distinct()
    wanted = np.zeros(1 << FILTER_BITS, bool)
    for batch in bits.toArrow().to_batches():  # at most 2 ** FILTER_BITS numbers, whatever the input
        wanted[batch.column(0).to_numpy()] = True
    return hashes.sparkSession.sparkContext.broadcast(np.packbits(wanted))


def _wanted(sent) -> np.ndarray:
    return np.unpackbits(sent.value, count=1 << FILTER_BITS).view(bool)


def _shingle_counts(docs: DataFrame, sent) -> DataFrame:
    """(shingle, n): occurrences in the corpus of the shingles the bit table lets through."""

    def scan(batches):
        wanted, values, counts = _wanted(sent), np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in pieces(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "alnum", True)
                both = np.concatenate([_pairs(words), words.hashes])
                found, n = np.unique(both[wanted[_bits(both)]], return_counts=True)
                values, where = np.unique(np.concatenate([values, found]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(values)).astype(np.int64)
                if len(values) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], ["shingle", "n"])
                    values, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], ["shingle", "n"])

    return docs.select("text").mapInArrow(scan, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def anchors(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(wid, len, words, shingle, off): the rarest shingle of each window, ties by hash, then place."""
    distinct = windows.groupBy("wid").agg(F.first("len").alias("len"), F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    each = distinct.select("wid", F.posexplode("shingles").alias("off", "shingle"))
    counts = _shingle_counts(docs, _filter(each, "shingle"))
    best = each.join(counts, "shingle", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "shingle", "off")).alias("best"))
    return distinct.join(best, "wid").select("wid", "len", "words", "best.shingle", "best.off")


def _places(docs: DataFrame, sent, width: int) -> DataFrame:
    """One row per document (``pos`` null) and one per place of a wanted shingle, with the words around."""
    reach = width - 1

    def scan(batches):
        wanted = _wanted(sent)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, rows = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "alnum", True)
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n), pa.array(rows[i:j]), pa.array(words.counts), *(pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                    NAMES,
                )
                pairs, text = _pairs(words), words.text_of()
                at = [np.flatnonzero(wanted[_bits(x)]) for x in (pairs, words.hashes)]
                shingle = np.concatenate([pairs[at[0]], words.hashes[at[1]]])
                at = np.concatenate(at)
                padded = np.concatenate([np.zeros(reach, np.uint64), words.hashes, np.zeros(reach, np.uint64)])
                begin, end = words.first[text[at]], words.first[text[at] + 1]
                for a in range(0, len(at), 1 << 15):
                    own = slice(a, a + (1 << 15))
                    around = padded[at[own, None] + np.arange(2 * reach + 1)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(around) + 1, dtype=np.int32) * (2 * reach + 1)), pa.array(signed(around.reshape(-1))))
                    where = at[own] - begin[own]
                    size = (end - begin)[own]
                    columns = [pa.nulls(len(around), pa.int64()), pa.array(rows[i:j][text[at[own]]]), pa.array(size), pa.array(where.astype(np.int32)), pa.array((size - where).astype(np.int32)), pa.array(signed(shingle[own])), lists]
                    yield pa.RecordBatch.from_arrays(columns, NAMES)

    NAMES = ["doc_id", ROW, "n_words", "pos", "left", "shingle", "around"]
    schema = f"doc_id long, {ROW} long, n_words long, pos int, left int, shingle long, around array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key()).mapInArrow(scan, schema)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the row key."""
    windows = store(item_windows(items, width), "item-windows")
    chosen = store(anchors(windows, docs), "anchors")
    places = store(_places(docs, _filter(chosen, "shingle"), width), "places")
    listed = windows.where("item_id IS NOT NULL").select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    # position and length bounds first, then the words themselves
    found = (
        places.where("pos IS NOT NULL")
        .join(if_small(chosen, BROADCAST_WINDOWS), "shingle")
        .where("pos >= off AND left >= len - off")
        .where(F.slice("around", F.lit(width) - F.col("off"), F.col("len")) == F.col("words"))
        .select(ROW, "wid", (F.col("pos") - F.col("off")).alias("a"), (F.col("pos") - F.col("off") + F.col("len")).alias("b"))
    )
    hits = store(found, "window-hits")
    spans = hits.select(ROW, "a", "b").distinct().groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
    )
    n_hit = spans.select(ROW, covered["n"].alias("n_hit"))
    names = hits.select(ROW, "wid").distinct().join(if_small(store(listed, "window-items"), BROADCAST_WINDOWS), "wid").groupBy(ROW).agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = store(n_hit.join(names, ROW, "left"), "contamination")
    none = F.array().cast("array<string>")
    return (
        places.where("pos IS NULL")
        .select("doc_id", ROW, "n_words")
        .join(if_small(marks), ROW, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            ROW,
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that hold no window of any item, all columns kept."""
    dirty = contamination(docs, items, width).where("contaminated").select(ROW).distinct()
    key = fresh(docs, ROW)
    return docs.withColumn(key, row_key()).join(if_small(store(dirty.withColumnRenamed(ROW, key), "dirty")), key, "left_anti").drop(key)
