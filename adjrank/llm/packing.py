"""Best-fit packing of token sequences, by a sweep on the driver over counts of lengths.

Documents are tokenized where they are read and cut into pieces of at most
``size`` tokens. Pieces and the gaps of begun sequences are kept sorted as
runs of equal length: how many pieces, or gaps, there are of each. In a round,
every run of pieces finds the smallest gap that holds it (its successor in the
sorted gaps). Where several runs want the same gaps, ranks decide: longer
pieces first, each run taking as many gaps as it has pieces. Gaps shrink, and
the next round begins with the pieces that are left; when none fits, the
longest ones open new sequences, as many as they need among themselves.

A run's pieces differ in nothing that matters here, so the rounds need only
the runs, of which there are no more than ``size`` however many documents
there are. They are counted over all pieces by Spark; the rounds over them are
a loop on the driver, not Spark jobs. A run takes its gaps at once, the longest
run first, so no conflicts are left to resolve. Each piece then finds
its place by its rank within its run: ranks come from counts by part of a run,
so a length that a third of all documents share is not numbered in one task.

Nulls and empty texts have the end token only. Rows that repeat are packed
like any others; they get places of their own. An empty table gives an empty
result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from adjrank.llm.words import Block, blocks, byte_weights, per_worker
from adjrank.session import scratch_path

SIZE = 4096
#: Token ids that a worker keeps for the words it has met; beyond that it begins anew.
KEPT = 1_500_000
#: Bytes of text that are worked on at once; arrays of eight times that size are made.
BLOCK_BYTES = 1 << 19
PUNCTUATION, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
PUNCTUATION[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = True
ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
#: A run is numbered in parts, of which there is one for so many pieces, and so many at most.
PART_PIECES, PARTS = 200_000, 256


class WordIds:
    """Token ids of texts, put together from those of their words.

    Only for tokenizers that drop white space and case and split letters from
    punctuation: then no token reaches across white space, nor from a letter
    to the ASCII punctuation that ends its word, and words that differ in the
    case of A-Z have the same ids. Special strings are the exception, so
    blocks that have one, in any case, are taken word by word as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.folded, self.plain = byte_weights(True), byte_weights(False)
        self.clear()

    def clear(self):
        self.place: dict[int, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list = [[x.id for x in self.model.tokenize(w.lower())] if w.isascii() and w.isalpha() else None for w in words]
        others = [i for i, x in enumerate(out) if x is None]
        found = self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False)
        for i, x in zip(others, found, strict=True):
            out[i] = x.ids
        return out

    def learn(self, hashes: list[int], words: list[str]):
        found = self.encode(words)
        sizes = np.array([len(x) for x in found], np.int64)
        before = len(self.ids) + np.cumsum(sizes) - sizes
        self.place.update(zip(hashes, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        self.starts, self.sizes = np.concatenate([self.starts, before]), np.concatenate([self.sizes, sizes])

    def units(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of what is looked up, and their hashes."""
        begins, ends = block.words()
        lowered = block.data.tobytes().lower()
        if any(x in lowered for x in self.special):
            return begins, ends, block.hashes(begins, ends, self.plain)
        if len(begins):
            data, at = block.data, np.arange(len(block.data))
            mark = PUNCTUATION[data]
            tail = np.maximum(np.maximum.accumulate(np.where(mark, -1, at))[ends - 1] + 1, begins)
            # a letter before the marks: ASCII, or of the two bytes C3 80 to C3 BF but for the signs × and ÷
            last, second = data[np.maximum(tail - 1, 0)], data[np.maximum(tail - 2, 0)]
            letter = ALNUM[last] | ((second == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (tail - 2 >= begins))
            cut = (tail < ends) & (tail > begins) & letter
            # cores and tails in the order of the text
            where = np.argsort(np.concatenate([begins, tail[cut]]), kind="stable")
            begins, ends = np.concatenate([begins, tail[cut]])[where], np.concatenate([np.where(cut, tail, ends), ends[cut]])[where]
        return begins, ends, block.hashes(begins, ends, self.folded)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for block in blocks(column, BLOCK_BYTES):
            if len(self.ids) > KEPT:
                self.clear()
            begins, ends, hashes = self.units(block)
            distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            names = distinct.tolist()
            new = [i for i, h in enumerate(names) if h not in self.place]
            if new:
                at = first[new]
                words = [block.bytes_of(a, b).decode() for a, b in zip(begins[at], ends[at], strict=True)]
                self.learn([names[i] for i in new], words)
            entry = np.array([self.place[h] for h in names], np.int64)[which]
            starts, sizes = self.starts[entry], self.sizes[entry]
            filled = np.cumsum(sizes)
            ids = self.ids[np.repeat(starts - filled + sizes, sizes) + np.arange(filled[-1] if len(filled) else 0)]
            bounds = np.concatenate([[0], filled])[block.bounds(begins)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[a:b]


PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def tokenized(docs: DataFrame, path: str, end: int, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every row: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    ``path`` is that of the tokenizer on every machine, ``end`` the id after each text.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        words = per_worker(f"word ids of {path}", lambda: WordIds(path))
        for batch in batches:
            row, out = [], []
            for i, ids in enumerate(words.texts(batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), size)):
                    held = ids[start : start + size]
                    row.append(i)
                    out.append((piece, start, len(held), zlib.crc32(held.tobytes())))
            columns = zip(*out, strict=True) if out else [[]] * len(PIECE)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *arrays], ["key", *(n for n, _ in PIECE)])

    schema = T.StructType([T.StructField("key", narrow.schema["key"].dataType), *(T.StructField(*x) for x in PIECE)])
    return narrow.mapInArrow(run, schema)


def sweep(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit rounds over runs of equal pieces.

    Returns assignments (length, first rank, count, first sequence, offset):
    the pieces of this length with these ranks go to consecutive sequences, at
    this offset.
    """
    left = {length: n for length, n in counts.items() if n and length}
    taken = dict.fromkeys(left, 0)
    gaps: dict[int, list[list[int]]] = {}  # by size, runs [first sequence, count] of sequences with such a gap
    sizes: list[int] = []  # the sizes in use, sorted
    out, opened = [], 0

    def place(length: int, first: int, n: int, gap: int):
        out.append((length, taken[length], n, first, size - gap))
        taken[length] += n
        left[length] -= n
        if gap > length:
            if gap - length not in gaps:
                insort(sizes, gap - length)
            gaps.setdefault(gap - length, []).append([first, n])

    while any(left.values()):
        # a sweep: each run of pieces, longest first, takes its successors among the gaps
        for length in sorted((x for x, n in left.items() if n), reverse=True):
            while left[length]:
                at = bisect_left(sizes, length)
                if at == len(sizes):
                    break
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if n > left[length]:
                    gaps[gap].append([first + left[length], n - left[length]])
                    n = left[length]
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                place(length, first, n, gap)
            else:
                continue
            break
        # the longest run that found no gap opens sequences, as few as can hold it; its other pieces find their gaps
        length = max((x for x, n in left.items() if n), default=0)
        if length:
            n = -(-left[length] // (size // length))
            place(length, opened, n, size)
            opened += n
    return out


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (with ``length`` from 1 to ``size``) with their ``sequence_id`` and ``offset``.

    The result reads ``pieces`` three times; store them if they are costly.
    """
    spark = pieces.sparkSession
    parts = min(PARTS, max(1, -(-pieces.count() // PART_PIECES)))
    part = F.pmod(F.xxhash64(*pieces.columns), F.lit(parts)).cast("int")
    split = pieces.withColumn("_part", part)
    sums = split.groupBy("length", "_part").count().collect()  # no more than size * PARTS rows
    runs: dict[int, int] = {}
    before = []
    for row in sorted(sums, key=lambda r: (r["length"], r["_part"])):
        before.append((row["length"], row["_part"], runs.get(row["length"], 0)))
        runs[row["length"]] = runs.get(row["length"], 0) + row["count"]
    if not before:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    starts = spark.createDataFrame(before, "length long, _part int, _before long")
    order = Window.partitionBy("length", "_part").orderBy(*pieces.columns)
    ranked = split.withColumn("_row", F.row_number().over(order)).join(F.broadcast(starts), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_row", "_before", "_part")
    # a length's assignments lie in a row by rank, so the one that holds a rank is the last that begins at or before it
    plan: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, first, offset in sweep(runs, size):
        plan.setdefault(length, []).append((rank, first - rank, offset))
    rows = [(length, [dict(zip(("rank", "shift", "offset"), x, strict=True)) for x in sorted(parts)]) for length, parts in plan.items()]
    table = spark.createDataFrame(rows, "length long, _plan array<struct<rank:long,shift:long,offset:long>>")
    last = F.element_at(F.filter("_plan", lambda x: x["rank"] <= F.col("_rank")), -1)
    placed = ranked.join(F.broadcast(table), "length").withColumn("_at", last)
    return placed.select(
        *pieces.columns, (F.col("_at.shift") + F.col("_rank")).alias("sequence_id"), F.col("_at.offset").alias("offset")
    )


def packed(docs: DataFrame, path: str, end: int, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize and pack: ``key``, the piece's columns, ``sequence_id`` and ``offset``."""
    where = scratch_path(docs.sparkSession, "pieces")
    tokenized(docs, path, end, size, key, text).write.parquet(where)
    return pack(docs.sparkSession.read.parquet(where), size).withColumnRenamed("key", key)
