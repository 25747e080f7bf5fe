"""A count-min sketch of 64-bit hashes that only tells what may occur twice.

Two rows of 2 ** bits cells. Tasks send the cells they hit, cut into blocks; blocks are merged by addition,
and of each cell one bit, whether it was hit twice, comes back: 32 MB for two rows of 2 ** 27 cells, whatever
the input. It never counts too few.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import mixed

BITS = 27
#: Cells of a block, which one task merges at a time.
BLOCK_BITS = 21

_ROWS = (np.uint64(0), np.uint64(0x9E3779B97F4A7C15))


#: Hashes that are counted at a time.
PORTION = 1 << 20


def _cut(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    for array in arrays:
        for first in range(0, len(array), PORTION):
            yield array[first : first + PORTION]


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(hashes ^ _ROWS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(
    rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int = BITS
) -> np.ndarray:
    """For each row of the sketch, a bit for each cell that was hit at least twice."""
    return sketch_portions(rows, lambda batches: map(hashes_of, batches), bits)


def sketch_portions(
    rows: DataFrame,
    portions_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]],
    bits: int = BITS,
) -> np.ndarray:
    """As sketch, of the hashes that `portions_of` makes of a task's batches."""
    block_bits = min(BLOCK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes in _cut(portions_of(batches)):
            blocks: list[int] = []
            packed: list[bytes] = []
            for row in range(len(_ROWS)):
                cells, times = np.unique(_cells(hashes, row, bits), return_counts=True)
                # Distances to the cell before, and whether the cell is hit twice here already.
                block = cells >> block_bits
                edges = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
                for first, end in zip(edges, [*edges[1:], len(cells)]):
                    inner = cells[first:end] & ((1 << block_bits) - 1)
                    code = (np.diff(inner, prepend=0) << 1 | (times[first:end] > 1)).astype("<u4")
                    blocks.append((row << (bits - block_bits)) + int(block[first]))
                    packed.append(zlib.compress(code.view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], ["block", "cells"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
                code = np.ascontiguousarray(planes.T).view("<u4").ravel()
                cells = np.cumsum(code >> 1)
                held = counts.setdefault(block, np.zeros(1 << block_bits, dtype=np.uint8))
                held[cells] = np.minimum(held[cells] + 1 + (code & 1).astype(np.uint8), 2)
        for block, held in counts.items():
            twice = np.packbits(held > 1, bitorder="little").tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "cells": [twice]})

    blocks = len(_ROWS) << (bits - block_bits)
    sent = rows.mapInArrow(count, "block int, cells binary")
    merged = sent.repartition(blocks, "block").mapInArrow(merge, "block int, cells binary")
    out = np.zeros((blocks, (1 << block_bits) // 8), dtype=np.uint8)
    for row in merged.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["cells"], dtype=np.uint8)
    return out.reshape(len(_ROWS), -1)


def hit_twice(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may have come twice; False is certain."""
    bits = (8 * twice.shape[1]).bit_length() - 1
    found = np.ones(len(hashes), dtype=bool)
    for row in range(len(_ROWS)):
        cell = _cells(hashes, row, bits)
        found &= (twice[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return found
