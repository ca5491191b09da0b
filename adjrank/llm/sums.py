"""Sums of fixed-size arrays that every task adds something to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adjrank.session import stored

#: Numbers that are added up in one place.
SLICE = 1 << 16
SCHEMA = "at int, cells binary"


def slices(cells: np.ndarray) -> pa.RecordBatch:
    """A task's array, cut into slices."""
    parts = [cells[i : i + SLICE].tobytes() for i in range(0, len(cells), SLICE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["at", "cells"])


def count_slices(counts: np.ndarray) -> pa.RecordBatch:
    """A task's counts, cut into slices that have something, each in the fewest bytes.

    A slice's first byte tells how many bytes a count has, and whether all are
    there in order or only those that are not 0, behind their places.
    """
    at, parts = [], []
    for i in range(0, len(counts), SLICE):
        cells = counts[i : i + SLICE]
        where = np.flatnonzero(cells)
        if not len(where):
            continue
        width = next(w for w in (1, 2, 4, 8) if int(cells.max()) < 1 << 8 * w)
        kind = f"<u{width}"
        if len(where) * (2 + width) < len(cells) * width:
            held = bytes([width | 16]) + where.astype("<u2").tobytes() + cells[where].astype(kind).tobytes()
        else:
            held = bytes([width]) + cells.astype(kind).tobytes()
        at.append(i // SLICE)
        parts.append(held)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(parts, pa.binary())], ["at", "cells"])


def counted(held: bytes) -> np.ndarray:
    """A slice of :func:`count_slices` again, as long as its last count needs."""
    width, few = held[0] & 15, held[0] & 16
    if not few:
        return np.frombuffer(held, f"<u{width}", offset=1).astype(np.uint64)
    n = (len(held) - 1) // (2 + width)
    where = np.frombuffer(held, "<u2", n, 1)
    out = np.zeros(int(where[-1]) + 1, np.uint64)
    out[where] = np.frombuffer(held, f"<u{width}", n, 1 + 2 * n)
    return out


def summed_counts(partial: DataFrame, size: int, most: int) -> np.ndarray:
    """The sum of the counts that tasks gave to :func:`count_slices`, none above ``most``."""
    kind = np.min_scalar_type(most)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = counted(held.as_py())
                sums.setdefault(at, np.zeros(min(SLICE, size - at * SLICE), np.uint64))[: len(cells)] += cells
        for at, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(cells, most).astype(kind).tobytes()])], ["at", "cells"])

    out = np.zeros(size, kind)
    # stored first: sums are made by all tasks at once, and the driver reads a file's worth after the other, not a job for each slice
    sums = stored(partial.repartition(-(-size // SLICE), "at").mapInArrow(add, SCHEMA), "sums")
    for row in sums.toLocalIterator():
        out[row["at"] * SLICE : (row["at"] + 1) * SLICE] = np.frombuffer(row["cells"], kind)
    return out


def summed(partial: DataFrame, size: int, kind: type) -> np.ndarray:
    """The sum of the arrays (of ``size`` and ``kind``) that tasks gave to :func:`slices`.

    A slice's parts are added one by one where they meet; the driver gets one array, in one job.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = np.frombuffer(held.as_py(), kind)
                sums[at] = sums[at] + cells if at in sums else cells
        for at, cells in sums.items():
            columns = [pa.array([at], pa.int32()), pa.array([cells.astype(kind).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["at", "cells"])

    out = np.zeros(size, kind)
    for row in partial.repartition(-(-size // SLICE), "at").mapInArrow(add, SCHEMA).collect():
        out[row["at"] * SLICE : (row["at"] + 1) * SLICE] = np.frombuffer(row["cells"], kind)
    return out
