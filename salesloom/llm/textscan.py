"""Words and n-grams of whole Arrow batches of text, as numpy arrays.

A batch of texts is one run of UTF-8 bytes. Words are found with a table of word bytes, and
each gets a 64-bit polynomial hash read off a running sum, so no Python loop touches a word.
Texts are handled in pieces of about ``PIECE`` bytes, cut between texts: memory follows the
piece (a longer text is a piece of its own, at a few bytes a byte), not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ALNUM = np.zeros(256, bool)  # digits, letters, and every byte of a character beyond ASCII
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _ALNUM[_low:_high] = True

WORD_BYTES = {"space": ~_SPACE, "alnum": _ALNUM}
U64 = np.uint64
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK = 1 << 16
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a well-known generator)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(seed: int, lower: bool) -> np.ndarray:
    values = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_FACTORS[0]) + U64(seed * 1_000_003 + 17))
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


def powers(factor: int) -> np.ndarray:
    """``factor ** 0 .. factor ** (BLOCK - 1)`` modulo 2**64."""
    if factor not in _powers:
        table = np.full(BLOCK, U64(factor))
        table[0] = 1
        _powers[factor] = np.multiply.accumulate(table)
    return _powers[factor]


def _inverse_powers(factor: int, at: np.ndarray) -> np.ndarray:
    """The inverse of ``factor ** at`` modulo 2**64, from two short tables."""
    if not len(at):
        return np.empty(0, U64)
    low = powers(pow(factor, -1, 1 << 64))
    high = np.full(int(at.max() // BLOCK) + 1, U64(pow(pow(factor, -1, 1 << 64), BLOCK, 1 << 64)))
    high[0] = 1
    return low[at % BLOCK] * np.multiply.accumulate(high)[at // BLOCK]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each pair of ascending bounds, wherever it stands.

    ``table`` maps small values (bytes) to 64-bit ones. The running sum is taken in blocks, so
    only the bounds and one block are held.
    """
    factor = _FACTORS[which]
    at_start, at_end = np.zeros(len(starts), U64), np.zeros(len(ends), U64)
    before, scale, total = U64(0), 1, np.empty(BLOCK + 1, U64)
    for a in range(0, len(values), BLOCK):
        part = values[a : a + BLOCK] if table is None else table[values[a : a + BLOCK]]
        size = len(part)
        total[0] = before
        np.cumsum(part * powers(factor)[:size], out=total[1 : size + 1])
        total[1 : size + 1] *= U64(scale)
        total[1 : size + 1] += before
        last = a + size
        for bounds, out in ((starts, at_start), (ends, at_end)):
            i, j = np.searchsorted(bounds, (a, last), "right")
            out[i:j] = total[bounds[i:j] - a]
        before = total[size]
        scale = scale * pow(factor, BLOCK, 1 << 64) % (1 << 64)
    return mix((at_end - at_start) * _inverse_powers(factor, starts) + (ends - starts).astype(U64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (n + 1); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE):
    """Ranges of rows whose texts hold about ``limit`` bytes together; at least one row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop
        row = stop


class Words:
    """The words of several texts: byte bounds, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str, lower: bool):
        word = WORD_BYTES[kind][data]
        if len(data):
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            edge = np.empty(len(data), bool)  # a word begins where the byte before is none, or of another text
            edge[0] = True
            np.logical_not(word[:-1], out=edge[1:])
            edge[inner] = True
            self.starts = np.flatnonzero(word & edge)
            edge[-1] = True
            np.logical_not(word[1:], out=edge[:-1])
            edge[inner - 1] = True
            self.ends = np.flatnonzero(word & edge) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        self.hashes = run_hashes(data, self.starts, self.ends, table=byte_values(1, lower))
        self.first = np.searchsorted(self.starts, offsets)  # word index where each text begins, and the end
        self.counts = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text (row) of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(words: Words, k: int, which: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of ``k`` words inside one text."""
    n = len(words.hashes)
    if n < k:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    text = words.text_of()
    at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    return run_hashes(words.hashes, at, at + k, which), text[at], at


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones that Spark's long holds."""
    return x.view(np.int64)


def distinct_per_text(values: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, the text of each, and how many each text has."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, text, np.bincount(text, minlength=n_texts)
