"""A Bloom filter of a column of hashes, built by each task for what it reads and merged by blocks."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_BITS, PROBES = 1 << 28, 4
BLOCK = 1 << 17  # bytes of a filter in one row


def bits_for(keys: int, each: int = 16) -> int:
    """A power of two, about ``each`` bits a key, at most ``MOST_BITS``: a filter's size is bounded, whatever the keys."""
    return min(MOST_BITS, max(1 << 20, 1 << (each * keys).bit_length()))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])


def has(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def put(held: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(held, (at >> np.uint64(3)).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())


def build(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of the one long column of ``hashes``; at most ``MOST_BITS`` bits reach the driver."""
    name = hashes.columns[0]

    def blocks(held: np.ndarray):
        for at in range(0, len(held), BLOCK):
            if held[at : at + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([at // BLOCK], pa.int32()), "held": [zlib.compress(held[at : at + BLOCK], 1)]})

    def fill(batches):
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                put(held, probes(batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64), bits))
        yield from blocks(held)

    def fold(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                block = np.frombuffer(zlib.decompress(r["held"]), np.uint8)
                held[r["block"]] = held[r["block"]] | block if r["block"] in held else block
        for k, v in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "held": [zlib.compress(v, 1)]})

    schema = "block int, held binary"
    merged = hashes.mapInArrow(fill, schema).repartition("block").mapInArrow(fold, schema)
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():
        block = np.frombuffer(zlib.decompress(r["held"]), np.uint8)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(block)] = block
    return out
