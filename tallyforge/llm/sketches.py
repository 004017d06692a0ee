"""Count-min sketches: how often each of many keys occurs, never too low, in a table of fixed size.

Each task counts its part of the input in rows of ``width`` counters and hands on its counters in blocks,
which are added block by block. What leaves the cluster is one bit a counter, whether it reached a limit:
``ROWS`` x ``width`` bits, whatever the input. A key whose counters all reached the limit may occur so often; any
other key certainly does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from .common import stored

#: Rows of counters; each has a hash of its own.
ROWS = 3
#: Counters that are handed on together.
BLOCK = 1 << 14
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SCHEMA = "block int, cells binary, n long"
#: A task's counters stop here; a sum of such counters is still no less than any limit up to it.
MOST = 65535


def cells_of(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each 64-bit hash in every row; ``width`` is a power of two."""
    shift = np.uint64(64 - (width.bit_length() - 1))
    with np.errstate(over="ignore"):
        return [((hashes ^ (hashes >> np.uint64(32))) * np.uint64(odd)) >> shift for odd in ODD]


class Counters:
    """One task's counters."""

    def __init__(self, width: int):
        self.width, self.n = width, 0
        self.cells = np.zeros((ROWS, width), "u4")

    def add(self, hashes: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.n += int(len(hashes) if counts is None else counts.sum())
        for row, at in zip(self.cells, cells_of(hashes, self.width), strict=True):
            if counts is None and len(hashes) * 8 < self.width:
                at, n = np.unique(at, return_counts=True)
                row[at] += n.astype("u4")
            elif counts is None:
                row += np.bincount(at.astype("i8"), minlength=self.width).astype("u4")
            else:
                row += np.bincount(at.astype("i8"), counts, self.width).astype("u4")

    def blocks(self) -> Iterator[pa.RecordBatch]:
        flat = np.minimum(self.cells, MOST).astype("<u2").reshape(-1, min(BLOCK, self.width))
        full = np.flatnonzero(flat.any(axis=1))
        rows = [(int(k), flat[k].tobytes(), self.n if k == full[0] else 0) for k in full]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["block", "cells", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, cells, n = None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(cells, MOST).astype("<u2").tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["block", "cells", "n"])

    for batch in batches:
        for b, part, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if b != block:
                if block is not None:
                    yield done()
                block, cells, n = b, np.zeros(len(part) // 2, "u8"), 0
            cells += np.frombuffer(part, "<u2")
            n += m
    if block is not None:
        yield done()


def _reached(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(c, "<u2") >= limit).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["block", "bits"])

    return run


class Often:
    """Which keys may have reached the limit; of fixed size."""

    def __init__(self, bits: np.ndarray, limit: int):
        self.bits, self.limit = bits, limit

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row, at in zip(self.bits, cells_of(hashes, self.bits.shape[1] * 8), strict=True):
            out &= (row[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype("u1") & 1).astype(bool)
        return out


def often_at(rows: DataFrame, count: Callable, width: int, *limits: Callable[[int], int]) -> list[Often]:
    """Adds up the counters that ``count`` makes of each task's part of ``rows``; each limit gets the number of what was counted."""
    ship(rows.sparkSession)
    parts = rows.mapInArrow(count, SCHEMA)
    added = stored(parts.repartition("block").sortWithinPartitions("block").mapInArrow(_added, SCHEMA), "counters")
    total, out = added.agg(F.sum("n")).first()[0] or 0, []
    for at in (limit(total) for limit in limits):
        if not 0 < at <= MOST:
            raise ValueError(f"counters of 16 bits can't tell {at}")
        bits = np.zeros((ROWS * width // min(BLOCK, width), min(BLOCK, width) // 8), "u1")
        for row in added.mapInArrow(_reached(at), "block int, bits binary").collect():  # a bit a counter
            bits[row["block"]] = np.frombuffer(row["bits"], "u1")
        out.append(Often(bits.reshape(ROWS, -1), at))
    return out


def often(rows: DataFrame, count: Callable, width: int, limit: Callable[[int], int]) -> Often:
    """As ``often_at``, with one limit."""
    return often_at(rows, count, width, limit)[0]
