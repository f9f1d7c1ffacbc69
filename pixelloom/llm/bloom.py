"""Bloom filters of 64-bit numbers: they spare work, and a full one loses nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordhash import mixed

_CHUNK = 1 << 17
#: Chunks that reach the driver at once, 16 KiB each.
_AT_ONCE = 256


def _places(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each number."""
    x = numbers.view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return (x & mask).astype(np.int64), (mixed(x) & mask).astype(np.int64)


def bloom(held: DataFrame, column: str, max_bits: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of ``held.column``, 64-bit numbers: log2 of its size, and its bits in bytes. Chunks are filled on executors."""
    bits = min(max_bits, max(17, (16 * held.count()).bit_length()))

    def positions(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // _CHUNK).astype(np.int32)), pa.array((at % _CHUNK).astype(np.int32))], ["chunk", "at"])

    def filled(batches):
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(chunk):
                chunks.setdefault(int(k), np.zeros(_CHUNK, bool))[at[chunk == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([np.packbits(b).tobytes() for b in chunks.values()], pa.binary())], ["chunk", "bits"])

    # Every partition that is fetched is a job of its own, so there are as few as the chunks at once allow.
    parts = -(-(1 << bits) // (_CHUNK * _AT_ONCE))
    spread = held.select(column).mapInArrow(positions, "chunk int, at int").repartition("chunk").coalesce(parts)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in spread.mapInArrow(filled, "chunk int, bits binary").toLocalIterator(prefetchPartitions=True):
        out[row["chunk"] * _CHUNK // 8 : (row["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits, out


def holds(filter_: tuple[int, np.ndarray], numbers: np.ndarray) -> np.ndarray:
    bits, held = filter_
    out = np.ones(numbers.shape, bool)
    for at in _places(np.ascontiguousarray(numbers), bits):
        out &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
