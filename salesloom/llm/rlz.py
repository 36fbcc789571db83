"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks of all documents.

Every window of ``width`` words has an anchor, its smallest hash of ``ANCHOR`` words, so equal
windows have equal anchors wherever they stand. Consecutive windows with one anchor form a
block; the blocks of all documents are the reference, indexed by anchor, and each window is in
exactly one of them. A document is parsed block by block: a block that the index holds a second
time, anchor and whole content, extends the current factor, and all its words are a duplicate
span. A factor ends in a block whose anchor is known but whose content differs; there the single
windows of that block are looked up among the windows of all blocks with that anchor, so a
repeat that begins or ends inside a block is found to the word. Blocks with an anchor of their
own repeat nothing.

Only anchors that occur twice leave the first shuffle, and only factor boundaries compare
windows. Sums by anchor are partial aggregations and the joins are ones Spark splits, so a
passage in a third of all documents is no group of its own.

Defined results: null, empty and shorter texts lose nothing; a row that is repeated counts as
another place, so both lose their windows; equal windows inside one document count; words stay
as they are (case counts); rows alike give rows alike; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import ROW, row_key, store
from salesloom.llm.textscan import Words, grams, mix, pieces, run_hashes, signed, text_bytes

WIDTH, ANCHOR = 35, 12


def _blocks(words: Words, width: int, anchor: int):
    """(anchor hash, content hash, text, first window, last window) of each block, windows by word."""
    n = len(words.hashes)
    none = np.empty(0, np.int64)
    if n < width:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    text = words.text_of()
    starts = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    hashes, _, at = grams(words, anchor)
    full = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    full[at] = hashes
    views = np.lib.stride_tricks.sliding_window_view(full, width - anchor + 1)
    best = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 1 << 15):
        own = starts[i : i + (1 << 15)]
        best[i : i + (1 << 15)] = views[own].argmin(1) + own
    new = np.ones(len(starts), bool)
    new[1:] = best[1:] != best[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b, place = starts[first], starts[last], best[first]
    content = run_hashes(words.hashes, a, b + width, 0) ^ mix((place - a).astype(np.uint64))
    return full[place], content, text[a], a, b


def index_blocks(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(h, content, row, span): the blocks of all documents; ``span`` packs first window and length."""
    names = ["h", "content", ROW, "span"]

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            rows = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "space", False)
                h, content, text, a, b = _blocks(words, width, anchor)
                span = ((a - words.first[text]) << 16) | (b - a)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(content)), pa.array(rows[i:j][text]), pa.array(span)], names)

    return docs.select("text", row_key()).mapInArrow(scan, f"h long, content long, {ROW} long, span long")


def factors(blocks: DataFrame) -> DataFrame:
    """(row, span, role) of blocks whose anchor occurs again.

    Role 0: the whole block is a duplicate. Role 1: it is, and its windows stand for it where
    others with its anchor differ. Role 2: a factor's boundary, whose windows must be looked up.
    """
    counted = blocks.groupBy("h").agg(F.count("*").alias("m"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    again = store(counted.where("m > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    known = store(blocks.join(again, "h"), "known-blocks")
    whole = known.where("NOT mixed").select(ROW, "span", F.lit(0).alias("role"))
    mixed = known.where("mixed")
    same = mixed.groupBy("h", "content").agg(F.count("*").alias("m"), F.min(F.struct(ROW, "span")).alias("one"))
    same = store(same, "block-contents")
    alone = same.where("m = 1").select(f"one.{ROW}", "one.span", F.lit(2).alias("role"))
    stands = same.where("m > 1").select(f"one.{ROW}", "one.span", F.lit(1).alias("role"))
    copies = mixed.join(same.where("m > 1").select("h", "content"), ["h", "content"], "left_semi").select(ROW, "span", F.lit(0).alias("role"))
    return whole.unionByName(alone).unionByName(stands).unionByName(copies)


def _report(words: Words, data: np.ndarray, t: int, covered: np.ndarray) -> tuple[int, bytes]:
    """Words removed of text ``t`` and the digest of the rest; ``covered`` by word of the text."""
    a, b = words.first[t], words.first[t + 1]
    kept = np.flatnonzero(~covered) + a
    starts, ends = words.starts[kept], words.ends[kept]
    return int(covered.sum()), b" ".join(data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist()))


def _cover(n: int, spans: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` words the packed spans of windows cover."""
    first, last = spans >> 16, (spans >> 16) + (spans & 0xFFFF) + width
    steps = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


FINAL = ["doc_id", "n_words", "n_removed", "kept"]


def _finish(texts: DataFrame, keep_text: bool, width: int) -> DataFrame:
    """Texts with their whole spans: settled ones with their result, others with windows to look up.

    Rows of three kinds: settled (kind 0), waiting with text and spans (1), windows (2).
    """
    names = ["kind", "doc_id", ROW, "n_words", "n_removed", "kept", "text", "spans", "at", "owned", "w1", "w2"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def rows(kind: int, size: int, **columns):
        columns["kind"] = np.full(size, kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds)], names)

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, keys, spans, roles = (batch.column(c).to_pylist() for c in ("doc_id", ROW, "spans", "roles"))
            for i, j in pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                words = Words(part, offsets[i : j + 1] - offsets[i], "space", False)
                done, waiting, asked = [], [], []
                for t in range(j - i):
                    n = int(words.counts[t])
                    own, role = np.array(spans[i + t] or [], np.int64), np.array(roles[i + t] or [], np.int64)
                    check = own[role > 0]
                    if not (role == 2).any():
                        removed, kept = _report(words, part, t, _cover(n, own, width) if len(own) else np.zeros(n, bool))
                        done.append((ids[i + t], keys[i + t], n, removed, kept.decode() if keep_text else hashlib.sha256(kept).hexdigest()))
                    else:
                        waiting.append((ids[i + t], keys[i + t], n, part[words.starts[words.first[t]] : words.ends[words.first[t + 1] - 1]].tobytes().decode(), own[role < 2]))
                    if len(check):
                        length = (check & 0xFFFF) + 1
                        at = np.repeat(check >> 16, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                        asked.append((keys[i + t], at, np.repeat(role[role > 0] == 2, length), at + words.first[t]))
                if done:
                    c = list(zip(*done))
                    yield rows(0, len(done), doc_id=c[0], **{ROW: c[1]}, n_words=c[2], n_removed=c[3], kept=c[4])
                if waiting:
                    c = list(zip(*waiting))
                    yield rows(1, len(waiting), doc_id=c[0], **{ROW: c[1]}, n_words=c[2], text=c[3], spans=[x.tolist() for x in c[4]])
                if asked:
                    at, owned, where = (np.concatenate([x[k] for x in asked]) for k in (1, 2, 3))
                    key = np.repeat([x[0] for x in asked], [len(x[1]) for x in asked])
                    order = np.argsort(where, kind="stable")
                    where = where[order]
                    hashes = [signed(run_hashes(words.hashes, where, where + width, k)) for k in (0, 1)]
                    yield rows(2, len(at), **{ROW: key[order]}, at=at[order], owned=owned[order], w1=hashes[0], w2=hashes[1])

    schema = f"kind int, doc_id long, {ROW} long, n_words long, n_removed long, kept string, text string, spans array<long>, at long, owned boolean, w1 long, w2 long"
    return texts.mapInArrow(scan, schema)


def substring_dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and the kept words joined by one space.

    ``kept`` is their SHA-256, or the text itself with ``keep_text``.
    """
    if width > 1 << 15 or not 0 < anchor <= width:
        raise ValueError("the anchor must be within the window, and the window within 32,768 words")
    blocks = store(index_blocks(docs, width, anchor), "blocks")
    found = factors(blocks).groupBy(ROW).agg(F.collect_list(F.struct("span", "role")).alias("found"))
    found = found.select(ROW, F.col("found.span").alias("spans"), F.col("found.role").alias("roles"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key()).join(found, ROW, "left")
    parsed = store(_finish(texts, keep_text, width), "parsed")
    windows = parsed.where("kind = 2").select(ROW, "at", "owned", "w1", "w2")
    # a row that is repeated asks for its windows twice, as it should: each is another place
    again = store(windows.groupBy("w1", "w2").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "windows-again")
    hits = windows.where("owned").join(again, ["w1", "w2"], "left_semi").groupBy(ROW).agg(F.collect_set("at").alias("hits"))
    waiting = parsed.where("kind = 1").select("doc_id", ROW, "n_words", "text", "spans").join(store(hits, "window-hits"), ROW, "left")

    def settle(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            spans, hits = batch.column("spans").to_pylist(), batch.column("hits").to_pylist()
            removed, kept = np.zeros(batch.num_rows, np.int64), []
            for i, j in pieces(offsets):
                part = data[offsets[i] : offsets[j]]
                words = Words(part, offsets[i : j + 1] - offsets[i], "space", False)
                for t in range(j - i):
                    own = np.array([*(spans[i + t] or []), *(x << 16 for x in hits[i + t] or [])], np.int64)
                    removed[i + t], rest = _report(words, part, t, _cover(int(words.counts[t]), own, width))
                    kept.append(rest.decode() if keep_text else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed), pa.array(kept, pa.string())], FINAL)

    late = waiting.mapInArrow(settle, "doc_id long, n_words long, n_removed long, kept string")
    return parsed.where("kind = 0").select(*FINAL).unionByName(late)
