"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

Vectors become integers, ``floor(64 * c)``, and are stored in blocks of rows.
With X the centred rows, step j takes one pass over the blocks: each task forms
``t = X v - beta u`` of its rows, and adds its share of ``X't`` and of ``U't``,
the part of t along all earlier left vectors. The driver keeps what has the
dimension of a vector only: the right vectors, to which every new one is made
orthogonal twice, and coefficients p with ``u = X p``, by which tasks have the
left vectors of their own rows again. What ``U't`` takes away from t is taken
from ``X't`` as well. A breakdown goes on with a pseudorandom direction
orthogonal to all earlier ones, so that equal and zero singular values are
found. After as many steps as there are dimensions the right vectors span
everything, and the singular value decomposition of the small bidiagonal
matrix gives all components; equal eigenvalues have some basis of their space.

Rows whose vector is null or has null or non-finite entries are dropped; the
rest must have one length (ValueError). Rows that repeat a key stay rows of
their own, a null key stays null. Components without variance cannot be
whitened and are left out, so equal vectors and a single one give no rows, as
an empty table does. A deviation beyond a bigint is an OverflowError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjrank.llm.sums import SCHEMA, slices, summed
from adjrank.session import stored

SCALE = 64
COMPONENTS = 32
BLOCK_ROWS = 4096
#: Relative to the largest coefficient: what counts as a breakdown, and singular values that count as zero.
BREAKDOWN, ZERO = 1e-12, 1e-9
#: Bytes of integers that a task reads in a pass: the lower while there are no more than so many tasks, else the upper.
TASK_BYTES, TASKS, MOST_TASK_BYTES = 1 << 20, 256, 32 << 20
KINDS = (np.int8, np.int16, np.int32, np.int64)


def _integers(vectors: pa.Array) -> np.ndarray:
    """Rows of ``floor(64 * c)``; all of one length."""
    rows, entries = len(vectors), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(vectors.offsets.to_numpy())
    if rows and lengths.min() != lengths.max():
        raise ValueError("vectors of several lengths")
    scaled = np.floor(entries * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("an entry is too large for a bigint")
    return scaled.astype(np.int64).reshape(rows, -1)


def integer_blocks(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Blocks of rows ``(keys, data, kind, n, dim, sums)``; ``data`` are integers as small as they can be."""
    entry = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(entry, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    narrow = vectors.where(F.col(vector).isNotNull() & finite).select(F.col(key).alias("key"), F.col(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                rows = _integers(part.column(1))
                most = int(np.abs(rows).max(initial=0))
                kind = next(k for k in KINDS if most <= np.iinfo(k).max)
                keys = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array([rows.astype(kind).tobytes()], pa.binary()),
                        pa.array([np.dtype(kind).name]),
                        pa.array([len(rows)], pa.int64()),
                        pa.array([rows.shape[1]], pa.int64()),
                        pa.array([rows.sum(0).tobytes()], pa.binary()),
                    ],
                    ["keys", "data", "kind", "n", "dim", "sums"],
                )

    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"keys array<{kind}>, data binary, kind string, n bigint, dim bigint, sums binary")


def _rows(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and integers of each block in a batch with ``data`` and ``kind`` first."""
    for i, (data, kind) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
        yield i, np.frombuffer(data.as_py(), kind.as_py()).reshape(-1, dim)


def total(blocks: DataFrame, dim: int, size: int, share: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``share(rows)``, an array of ``size``, added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            for _, rows in _rows(batch, dim):
                sums += share(rows.astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])

    parts = blocks.select("data", "kind").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    out = np.zeros(size)
    for row in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[row["at"]] = row["x"]
    return out


class Spectrum(NamedTuple):
    """Unit components (columns) of centred rows with their eigenvalues, and the trace of the covariance."""

    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def _orthogonal(v: np.ndarray, held: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - held @ (held.T @ v)
    return v


def bidiagonalise(blocks: DataFrame, n: int, mean: np.ndarray) -> Spectrum:
    """Components of all rows, by as many steps as they have dimensions."""
    dim = len(mean)
    draw = np.random.default_rng(0)
    right, left, images = np.empty((dim, 0)), np.empty((dim, 0)), np.empty((dim, 0))  # v, p with u = X p, and X'u
    small = np.zeros((dim, dim))
    v, beta, scale, squares = draw.standard_normal(dim), 0.0, 0.0, 0.0
    v /= np.linalg.norm(v)
    for j in range(dim):
        right = np.column_stack([right, v])
        factors = np.column_stack([v, left])
        shift = mean @ factors

        def share(rows: np.ndarray, factors=factors, shift=shift, beta=beta) -> np.ndarray:
            made = rows @ factors - shift
            t, own = made[:, 0], made[:, 1:]
            if own.shape[1]:
                t = t - beta * own[:, -1]
            centred = ((rows - mean) ** 2).sum() if not own.shape[1] else 0.0
            return np.concatenate([[t @ t, centred], own.T @ t, rows.T @ t - mean * t.sum()])

        sums = total(blocks, dim, 2 + left.shape[1] + dim, share)
        if j == 0:
            squares = float(sums[1])
        along, image = sums[2 : 2 + left.shape[1]], sums[2 + left.shape[1] :]
        alpha = float(np.sqrt(max(sums[0] - along @ along, 0.0)))
        scale = max(scale, alpha, beta)
        if j:
            small[j - 1, j] = beta
        if alpha <= BREAKDOWN * scale:
            # v is mapped onto earlier left vectors alone
            alpha, p, image = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            p = (v - (beta * left[:, -1] if j else 0.0) - left @ along) / alpha
            image = (image - images @ along) / alpha
        small[j, j] = alpha
        left, images = np.column_stack([left, p]), np.column_stack([images, image])
        v = _orthogonal(image - alpha * v, right)
        beta = float(np.linalg.norm(v))
        if beta <= BREAKDOWN * scale:
            beta, v = 0.0, _orthogonal(draw.standard_normal(dim), right)
        length = np.linalg.norm(v)
        v = v / length if length else v
    _, sigma, turned = np.linalg.svd(small)
    return Spectrum(right @ turned.T, sigma**2 / n, squares / n)


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each remaining row and component: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    blocks = stored(integer_blocks(vectors, key, vector), "integers")
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    # many passes follow, so no task of theirs should open many small files
    tasks = min(-(-size // TASK_BYTES), max(TASKS, -(-size // MOST_TASK_BYTES)))
    blocks = stored(blocks.coalesce(max(1, tasks)), "blocks")
    kind = blocks.schema["keys"].dataType.elementType
    out = T.StructType(
        [T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in ("whitened", "explained", "identity_error")]
    )
    n, least, dim = blocks.agg(F.sum("n"), F.min("dim"), F.max("dim")).first()
    if not n or not dim:
        return vectors.sparkSession.createDataFrame([], out)
    if least != dim:
        raise ValueError("vectors of several lengths")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dim, np.int64)
        for batch in batches:
            for held in batch.column(0):
                sums += np.frombuffer(held.as_py(), np.int64)
        yield slices(sums)

    sums = summed(blocks.select("sums").mapInArrow(add, SCHEMA), dim, np.int64)
    mean = sums / n
    found = bidiagonalise(blocks, n, mean)
    used = np.flatnonzero(found.eigenvalues > ZERO**2 * found.eigenvalues[0])[:components]
    if not len(used):
        return vectors.sparkSession.createDataFrame([], out)
    map_to = found.components[:, used] / np.sqrt(found.eigenvalues[used])
    shift, k = mean @ map_to, len(used)

    def moments(rows: np.ndarray) -> np.ndarray:
        made = rows @ map_to - shift
        return np.concatenate([made.sum(0), (made.T @ made).ravel()])

    held = total(blocks, dim, k + k * k, moments) / n
    error = float(np.abs(held[k:].reshape(k, k) - np.outer(held[:k], held[:k]) - np.eye(k)).max())
    explained = found.eigenvalues[used] / found.trace

    def deviations(rows: np.ndarray) -> np.ndarray:
        apart = rows.astype(object) * n - sums.astype(object) if _wide(rows) else rows.astype(np.int64) * n - sums
        if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * dim >= 2**63:
            apart = apart.astype(object)
        squares = (apart * apart).sum(1)
        if squares.dtype == object and max(squares, default=0) >= 2**63:
            raise OverflowError("a deviation is too large for a bigint")
        return squares.astype(np.int64)

    def _wide(rows: np.ndarray) -> bool:
        return (int(np.abs(rows.astype(np.int64)).max(initial=0)) + 1) * n * 2 >= 2**63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, rows in _rows(batch, dim):
                each = np.repeat(np.arange(len(rows)), k)
                made = rows.astype(np.float64) @ map_to - shift
                columns = [
                    batch.column(2)[i].values.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), n, np.int64)),
                    pa.array(deviations(rows)[each]),
                    pa.array(made.ravel()),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return blocks.select("data", "kind", "keys").mapInArrow(run, out)
