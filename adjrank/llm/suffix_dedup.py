"""Repeats of 50 bytes across documents, by blockwise sorting of suffixes with a difference cover.

Texts are stored in chunks that follow each other in document order. Then

1. A difference cover of the positions is ranked first: for any two positions
   there is a distance below PERIOD at which both have a sample. So two equal
   strings of 50 bytes hold, at the same place, two samples whose next
   50 - PERIOD + 1 bytes are equal. The samples' strings are sorted bucket by
   bucket; each gets the rank "unique" or "repeated" back.
2. Only suffixes with a repeated sample within PERIOD bytes can repeat for 50
   bytes. They are sorted bucket by bucket, by a 64-bit key of their first 50
   bytes. Of a chunk's equal suffixes only the first is dealt; a bucket tells
   it whether a smaller document has the same.
3. Each chunk puts the answers on its text: the bytes that strings of smaller
   documents cover go.

A bucket has a bounded number of suffixes, whatever the input: strings are
dealt by hash, and a string that all documents share is one suffix for each
chunk. No tie is deeper than 50 bytes here, so the sample's ranks decide which
suffixes are sorted at all instead of ending comparisons. Buckets and chunks
exchange sorted, delta-coded numbers and one bit for each in return. Of n
suffixes that repeat, about n * n / 2**65 may be taken for equal wrongly.

Null and empty texts have nothing to remove. Rows that repeat a key are
compared with other keys only, as no key is smaller than itself. A null key is
neither smaller nor larger than any: its row stays whole and removes nothing.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjrank.llm.tables import bucketed
from adjrank.llm.words import STEP, Powers, mix
from adjrank.operators.position import global_index
from adjrank.session import stored

WIDTH = 50
#: Fixed: a perfect difference cover; every difference modulo 21 is that of two of the five.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
NAME = WIDTH - PERIOD + 1
#: Bytes of text in a chunk (a longer text is a chunk of its own) and in a stored part.
CHUNK, PART_BYTES = 4 << 20, 16 << 20
#: Suffixes in a bucket, and the fewest buckets.
BUCKET, LEAST_BUCKETS = 4 << 20, 64
PIECE = 1 << 20
WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))

BITS = "chunk bigint, bucket int, bits binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Rows ``key``, ``text`` (binary) as chunks ``(chunk, low, high, keys, texts)`` in the order of keys."""
    kind = docs.schema["key"].dataType.simpleString()

    def chunk(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("key").combine_chunks()
        keys, texts = (rows.column(i).combine_chunks() for i in (0, 1))
        keys, texts = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (keys, texts))
        ends = pa.array([0, len(keys)], pa.int32())
        arrays = [pa.array([number]), keys[:1], keys[-1:], pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, texts)]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "low", "high", "keys", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            first = 0
            while first < batch.num_rows:
                before = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + CHUNK - size, side="right")))
                held.append(batch.slice(first, last - first))
                size += int(sizes[min(last, batch.num_rows) - 1] - before)
                first = last
                if size >= CHUNK or first < batch.num_rows:
                    yield chunk(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield chunk(number, held)

    schema = f"chunk bigint, low {kind}, high {kind}, keys array<{kind}>, texts array<binary>"
    return docs.mapInArrow(run, schema)


def encode(numbers: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as the bytes of their differences, highest bytes together."""
    steps = np.diff(numbers, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def decode(held: bytes) -> np.ndarray:
    planes = np.frombuffer(held, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def hashes(data: np.ndarray, at: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hash of the ``width`` bytes from each of the sorted positions on."""
    out = np.empty(len(at), np.uint64)
    for first in range(0, len(data), PIECE):
        lo, hi = np.searchsorted(at, (first, first + PIECE))
        if lo < hi:
            part = data[first : first + PIECE + width]
            up, down = powers.upto(PIECE + width)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(WEIGHTS[part] * up[: len(part)], out=sums[1:])
            here = at[lo:hi] - first
            out[lo:hi] = mix((sums[here + width] - sums[here]) * down[here])
    return out


class Groups:
    """Equal numbers among ``values``: sorted different ``keys``, the group of each value, and its first value."""

    def __init__(self, values: np.ndarray, bits: int = 64):
        n = len(values)
        low = max(1, (n - 1).bit_length()) if n else 1
        if bits + low <= 64:  # number and place in one
            both = np.sort((values << np.uint64(low)) | np.arange(n, dtype=np.uint64))
            ordered, order = both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype(np.int64)
        else:
            order = np.argsort(values)
            ordered = values[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new)
        self.keys = ordered[starts]
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = np.minimum.reduceat(order, starts) if n else starts
        self.last = np.maximum.reduceat(order, starts) if n else starts


class Chunk:
    """A chunk's texts, with the positions that can begin a string of some width."""

    def __init__(self, keys: pa.Array, texts: pa.Array, powers: Powers):
        texts = texts.cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
        self.keys, self.powers = keys, powers
        self.data, self.bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        self.rank = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64)

    def begins(self, width: int) -> np.ndarray:
        """Marks positions with ``width`` bytes to the end of their text."""
        ends = self.bounds[1:]
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, np.maximum(self.bounds[:-1], ends - width + 1), 1)
        np.add.at(change, ends, -1)
        return np.cumsum(change[:-1], dtype=np.int32) == 0

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def names(self, bits: int) -> tuple[np.ndarray, Groups]:
        """The samples and their strings, hashed to ``bits``."""
        sample = np.zeros(PERIOD, bool)
        sample[list(COVER)] = True
        here = np.resize(sample, len(self.data)) if len(self.data) else sample[:0]
        at = np.flatnonzero(here & self.begins(NAME))
        return at, Groups(hashes(self.data, at, NAME, self.powers) >> np.uint64(64 - bits), bits)

    def suffixes(self, bits: int, elsewhere: np.ndarray) -> tuple[np.ndarray, Groups]:
        """The suffixes that can repeat, given which names other chunks have as well."""
        at, names = self.names(bits)
        here = self.rank[self.row(at)]
        several = here[names.first] != here[names.last] if len(at) else elsewhere
        repeated = at[(several | elsewhere)[names.of]]
        marks = np.zeros(len(self.data) + PERIOD, np.int32)
        marks[repeated] = 1
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        near = sums[PERIOD:][: len(self.data)] > sums[: len(self.data)]
        at = np.flatnonzero(near & self.begins(WIDTH))
        return at, Groups(hashes(self.data, at, WIDTH, self.powers))

    def removed(self, bits: int, names: np.ndarray, smaller: np.ndarray) -> pa.RecordBatch:
        """The rows without what smaller documents have, given the answers to both rounds."""
        at, same = self.suffixes(bits, names)
        row = self.row(at)
        if len(at):
            hit = (self.rank[row] > self.rank[row[same.first]][same.of]) | smaller[same.of]
            at, row = at[hit], row[hit]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] > at[:-1] + WIDTH) | (row[1:] != row[:-1])
        starts = np.flatnonzero(new)
        begin, end = at[starts], at[np.append(starts[1:], len(at)) - 1] + WIDTH if len(at) else at
        row = row[starts]
        gone = np.zeros(len(self.data) + 1, np.int32)
        gone[begin] += 1
        np.add.at(gone, end, -1)
        kept = np.cumsum(gone[:-1], dtype=np.int32) == 0
        sums = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        left = self.data[kept].tobytes()
        n_spans = np.searchsorted(row, np.arange(len(self.keys) + 1))
        base = self.bounds[:-1][row]
        spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["start", "end"])
        return pa.RecordBatch.from_arrays(
            [
                self.keys,
                pa.array(np.diff(self.bounds)),
                pa.ListArray.from_arrays(pa.array(n_spans, pa.int32()), spans),
                pa.Array.from_buffers(pa.binary(), len(self.keys), [None, pa.py_buffer(sums[self.bounds].astype(np.int32)), pa.py_buffer(left)]),
            ],
            ["key", "n_bytes", "spans", "kept"],
        )


def _dealt(keys: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of the parts of sorted ``bits``-bit keys."""
    edges = np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(b, x, y) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]


def _answers(column: pa.Array, row: int, sizes: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """The bits that buckets gave a chunk, for all its keys in order."""
    out = np.zeros(n, bool)
    held = column[row].as_py() or []
    found = {x["bucket"]: x["bits"] for x in held}
    for bucket, first, last in sizes:
        if bucket in found:
            out[first:last] = np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=last - first)
    return out


def _chunks(batch: pa.RecordBatch, powers: Powers) -> Iterator[tuple[int, Chunk]]:
    """The chunks of a batch with ``keys`` and ``texts`` first."""
    for i in range(batch.num_rows):
        yield i, Chunk(batch.column(0)[i].values, batch.column(1)[i].values, powers)


def _rows(chunk: int, keys: np.ndarray, dealt: list[tuple[int, int, int]], extra: np.ndarray | None = None) -> pa.RecordBatch:
    columns = {
        "bucket": pa.array([b for b, _, _ in dealt], pa.int32()),
        "chunk": pa.array([chunk] * len(dealt), pa.int64()),
        "keys": pa.array([encode(keys[x:y]) for _, x, y in dealt], pa.binary()),
    }
    if extra is not None:
        columns["edges"] = pa.array([extra[x:y].tobytes() for _, x, y in dealt], pa.binary())
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    return stored(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), name)


def _bits_of(table: pa.Table, marks: list[np.ndarray]) -> pa.Table:
    bits = pa.array([np.packbits(x).tobytes() for x in marks], pa.binary())
    return pa.table([table.column("chunk"), table.column("bucket"), bits], names=["chunk", "bucket", "bits"])


def _repeated_names(texts: DataFrame, bits: int, buckets: int) -> DataFrame:
    """For each chunk, which of its samples' strings another chunk has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, chunk in _chunks(batch, powers):
                keys = chunk.names(bits)[1].keys
                yield _rows(batch.column(2)[i].as_py(), keys, _dealt(keys, bits, buckets))

    def bucket(table: pa.Table) -> pa.Table:
        each = [decode(x.as_py()) for x in table.column("keys")]
        ordered = np.sort(np.concatenate(each))
        repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(repeated):
            return _bits_of(table, [np.zeros(len(x), bool) for x in each])
        found = (np.minimum(np.searchsorted(repeated, x), len(repeated) - 1) for x in each)
        return _bits_of(table, [repeated[at] == x for at, x in zip(found, each, strict=True)])

    dealt = texts.select("keys", "texts", "chunk").mapInArrow(run, "bucket int, chunk bigint, keys binary")
    return _by_chunk(dealt.groupBy("bucket").applyInArrow(bucket, BITS), "names")


def _smaller(texts: DataFrame, codes: DataFrame, names: DataFrame, bits: int, buckets: int) -> DataFrame:
    """For each chunk, which of its different suffixes a smaller document of another chunk has."""
    asked = texts.join(names.join(codes, "chunk").hint("shuffle_hash"), "chunk")
    asked = asked.select("keys", "texts", "chunk", "names", "first", "inner", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, chunk in _chunks(batch, powers):
                keys = chunk.names(bits)[1].keys
                at, same = chunk.suffixes(bits, _answers(batch.column(3), i, _dealt(keys, bits, buckets), len(keys)))
                rank = chunk.rank[chunk.row(at)][same.first] if len(at) else at
                edges = np.where(rank == chunk.rank.min(initial=1), 1, np.where(rank == chunk.rank.max(initial=1), 2, 0)).astype(np.uint8)
                out = _rows(batch.column(2)[i].as_py(), same.keys, _dealt(same.keys, 64, buckets), edges)
                for x in (4, 5, 6):
                    out = out.append_column(batch.schema.names[x], pa.array([batch.column(x)[i].as_py()] * out.num_rows, pa.int64()))
                yield out

    def bucket(table: pa.Table) -> pa.Table:
        each = [decode(x.as_py()) for x in table.column("keys")]
        sizes = [len(x) for x in each]
        edges = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("edges")])
        code = np.repeat(table.column("inner").to_numpy(), sizes)
        for edge, name in ((1, "first"), (2, "last")):
            code = np.where(edges == edge, np.repeat(table.column(name).to_numpy(), sizes), code)
        same = np.concatenate(each)
        order = np.argsort(same)
        new = np.ones(len(order), bool)
        new[1:] = same[order][1:] != same[order][:-1]
        least = np.minimum.reduceat(code[order], np.flatnonzero(new))
        smaller = np.empty(len(order), bool)
        smaller[order] = code[order] > least[np.cumsum(new) - 1]
        return _bits_of(table, np.split(smaller, np.cumsum(sizes)[:-1]))

    schema = "bucket int, chunk bigint, keys binary, edges binary, first bigint, inner bigint, last bigint"
    return _by_chunk(asked.mapInArrow(run, schema).groupBy("bucket").applyInArrow(bucket, BITS), "smaller")


def _codes(spans: DataFrame) -> DataFrame:
    """The order of chunks' first and last keys, and of what lies between, as numbers."""
    ends = spans.select(F.explode(F.array("low", "high")).alias("key")).distinct()
    places = stored(global_index(ends, [F.asc("key")]), "places")
    first = places.select(F.col("key").alias("low"), F.col("pos").alias("a"))
    last = places.select(F.col("key").alias("high"), F.col("pos").alias("b"))
    both = spans.join(first, "low").join(last, "high")
    return stored(both.select("chunk", (2 * F.col("a")).alias("first"), (2 * F.col("a") + 1).alias("inner"), (2 * F.col("b")).alias("last")), "codes")


def _overlap(codes: DataFrame) -> bool:
    """Whether a chunk's keys reach into another's."""
    wide = F.col("last") > F.col("inner") + 1
    twice = codes.where("last > first").groupBy("first").agg(F.count("*").alias("n")).where("n > 1")
    return not codes.where(wide).isEmpty() or not twice.isEmpty()


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its ``key``, ``n_bytes``, removed ``spans`` (bytes, end exclusive) and the bytes ``kept``."""
    bytes_of = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    narrow = docs.select(F.col(key).alias("key"), bytes_of.alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    keyed = narrow.where("key is not null")
    for ordered in (False, True):
        if ordered:  # the table's own order does not follow the keys
            keyed = keyed.repartitionByRange(parts, "key", F.xxhash64("text")).sortWithinPartitions("key")
        texts = bucketed(chunked(keyed), "chunks", parts, "chunk")
        codes = _codes(texts.select("chunk", "low", "high"))
        if ordered or not _overlap(codes):
            break
    samples = max(1, total * len(COVER) // PERIOD)
    bits = min(64, samples.bit_length() + 8)
    buckets = max(LEAST_BUCKETS, -(-samples // BUCKET))
    names = _repeated_names(texts, bits, buckets)
    smaller = _smaller(texts, codes, names, bits, buckets)
    told = texts.join(names.join(smaller, "chunk", "left").hint("shuffle_hash"), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, chunk in _chunks(batch, powers):
                keys = chunk.names(bits)[1].keys
                held = _answers(batch.column(2), i, _dealt(keys, bits, buckets), len(keys))
                own = chunk.suffixes(bits, held)[1].keys
                yield chunk.removed(bits, held, _answers(batch.column(3), i, _dealt(own, 64, buckets), len(own)))

    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    found = told.select("keys", "texts", "names", "smaller").mapInArrow(run, schema)
    unkeyed = narrow.where("key is null").select(
        "key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("text").alias("kept")
    )
    return found.unionByName(unkeyed).withColumnRenamed("key", key)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of :func:`without_repeats`."""
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        key, "n_bytes", length.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
