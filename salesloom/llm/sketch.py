"""Counts of 64-bit hashes in a table of fixed size, summed over all tasks.

A counter is at least the true count of every hash that falls on it. The table has the same
size whatever the input (``2 ** BITS`` counters), so it may be held by the driver and sent to
every task. A task writes its counters in ``SLICES`` compressed slices, which are added up by
slice number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

BITS = 20
SLICES = 256


def counter_of(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def slices(counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Slice numbers and compressed counters, empty slices left out."""
    packer = zstandard.ZstdCompressor(level=1)
    parts = counts.astype(np.int64).reshape(SLICES, -1)
    some = np.flatnonzero(parts.any(1))
    return some.astype(np.int32), [packer.compress(parts[i].tobytes()) for i in some.tolist()]


def total(parts: DataFrame, slice_col: str, blob_col: str, bits: int = BITS) -> np.ndarray:
    """All counters, from a table of slices of many tasks; missing slices are zero."""

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        opener = zstandard.ZstdDecompressor()
        whole = np.zeros((1 << bits) // SLICES, np.int64)
        for blob in pdf["blob"]:
            whole += np.frombuffer(opener.decompress(blob), np.int64)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "blob": [zstandard.ZstdCompressor(level=1).compress(whole.tobytes())]})

    named = parts.where(f"{slice_col} IS NOT NULL").selectExpr(f"{slice_col} AS slice", f"{blob_col} AS blob")
    summed = named.groupBy("slice").applyInPandas(add_up, "slice int, blob binary")
    out = np.zeros((SLICES, (1 << bits) // SLICES), np.int64)
    for row in summed.toLocalIterator():
        out[row.slice] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.blob)), np.int64)
    return out.reshape(-1)
