"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

1. Documents with equal shingle sets are one class; only classes go on.
2. A sketch of the shingles' document frequencies, summed over all documents,
   puts them into one order, rare ones first. Two sets of the wanted
   likeness share a shingle among their first ones, as many as the threshold
   leaves free to differ. Only these leading entries are multiplied.
3. Within a shingle's column every class is first held against one central
   class, and what that doesn't join against a few more. That joins large
   groups of near copies in linear work.
4. The product is then taken block by block between classes that are not
   joined yet. Blocks are ranges of set sizes, so that only neighbouring ones
   can hold likely pairs. Overlap counts are accumulated for each pair, and
   pairs below the bound that their sizes set are discarded.
5. What is left is decided by the exact intersection of the whole sets.

So no pair is lost, and pairs within a group that is joined are not built.
Hot columns are cut by class in step 3 and split by Spark's skew join in step
4. Shingles are compared by 64-bit hashes.

Null and empty texts, and those without words, have no shingles and link to
nothing. Rows that repeat a key are rows of their own in the result, and each
has the smallest key that its text's class can reach. A null key is never the
smallest; a group with no other has null. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjrank.llm.components import connected_components, extended
from adjrank.llm.sums import SCHEMA, count_slices, summed_counts
from adjrank.llm.tables import Scratch
from adjrank.llm.words import blocks, byte_weights, free_worker, mix, repeats, shingles, total
from adjrank.session import stored

#: Sketch cells: at least so many for each document, between the two bounds (powers of two).
CELLS_A_DOCUMENT, LEAST_BITS, MOST_BITS = 8, 16, 24
#: Classes of a column that are held against one central class.
COLUMN = 2000
#: Pseudorandom centres of a column that its classes are held against after the first.
CENTRES = 6
PAIR_BYTES = 4 << 20
#: Up to so many classes (two numbers each) are broadcast to pick their texts; for more, the texts are shuffled.
FEW = 500_000


@dataclass(frozen=True)
class Likeness:
    """Sets link if ``over * intersection >= under * union``."""

    under: int = 85
    over: int = 100
    words: int = 4

    def leading(self, n: np.ndarray) -> np.ndarray:
        """How many first shingles of a set of ``n`` have to be looked at."""
        return n - (self.under * n + self.over - 1) // self.over + 1

    def least_overlap(self, a: str, b: str) -> str:
        """SQL for the smallest intersection of sets of these sizes that links."""
        return f"ceil({self.under} * ({a} + {b}) / {self.under + self.over})"

    def smallest(self, n: str) -> str:
        """SQL for the size of the smallest set that links to one of this size."""
        return f"ceil({self.under} * {n} / {self.over})"


def _sets(texts: pa.Array, words: int, weights: np.ndarray):
    """Blocks of texts with the text and hash of every distinct shingle."""
    for block in blocks(texts):
        starts, ends = block.words()
        rows, found = shingles(block.hashes(starts, ends, weights), np.diff(block.bounds(starts)), words)
        _, later = repeats(rows, found)
        yield block, rows[~later], found[~later]


def frequency_sketch(docs: DataFrame, text: str, words: int, bits: int) -> np.ndarray:
    """Counts of documents by the first ``bits`` of their shingles' hashes, over all documents.

    A task sends its counts once, those that are not 0, in slices that are added
    up where they meet; the sketch has 2**bits numbers whatever the input is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        cells, weights = np.zeros(1 << bits, np.uint32), byte_weights(True)
        for batch in batches:
            for _, _, found in _sets(batch.column(0), words, weights):
                where, n = np.unique(found >> np.uint64(64 - bits), return_counts=True)
                cells[where.astype(np.int64)] += n.astype(np.uint32)
        yield count_slices(cells)

    own = docs.select(F.col(text).alias("text")).mapInArrow(count, SCHEMA)
    return summed_counts(own, 1 << bits, 2**32 - 1)


def describe(docs: DataFrame, key: str, text: str, like: Likeness, sketch) -> DataFrame:
    """For each row: its key, class, set size, how common its leading shingles are, and these themselves."""
    bits = int(np.log2(len(sketch.value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, counts = byte_weights(True), sketch.value
        for batch in batches:
            for block, rows, found in _sets(batch.column(1), like.words, weights):
                seen = counts[(found >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((found, seen, rows))
                rows, found, seen = rows[order], found[order], seen[order]
                n = np.bincount(rows, minlength=block.rows)
                ends = np.cumsum(n)
                lead = np.where(n > 0, like.leading(n), 0)
                first = np.arange(len(rows)) - np.repeat(ends - n, n) < np.repeat(lead, n)
                sums = np.zeros(len(found) + 1, np.uint64)
                np.cumsum(mix(found), out=sums[1:])
                node = mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)
                heat = np.log2(seen[first] + 1.0)
                where = np.concatenate([[0], np.cumsum(lead)])
                common = total((heat * 1024).astype(np.int64), where) // np.maximum(lead, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.array(node),
                        pa.array(n),
                        pa.array(common),
                        pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(found[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(seen[first].astype(np.int64))),
                    ],
                    ["key", "node", "n", "common", "leading", "seen"],
                )

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, node bigint, n bigint, common bigint, leading array<bigint>, seen array<bigint>")


def exact(pairs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs ``a``, ``b`` whose texts ``text_a`` and ``text_b`` link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        weights = byte_weights(True)
        for batch in batches:
            sizes = np.add(*(pc.binary_length(batch.column(i)).to_numpy().astype(np.int64) for i in (2, 3)))
            cut_at = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIR_BYTES, prepend=-1))
            for first, last in zip(cut_at, [*cut_at[1:], batch.num_rows], strict=True):
                part = batch.slice(int(first), int(last - first))
                row, found = [], []
                for i in (2, 3):
                    for block, rows, hashes in _sets(part.column(i), like.words, weights):
                        row.append(rows + block.first)
                        found.append(hashes)
                row, found = np.concatenate(row), np.concatenate(found)
                _, later = repeats(row, found)
                both = np.bincount(row[later], minlength=part.num_rows)
                union = np.bincount(row, minlength=part.num_rows) - both
                yield part.select(["a", "b"]).filter(pa.array((both > 0) & (like.over * both >= like.under * union)))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _nodes(part: pa.RecordBatch, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Class of each text of a block from its distinct shingles."""
    order = np.argsort(rows, kind="stable")
    n = np.bincount(rows, minlength=part.num_rows)
    ends, sums = np.cumsum(n), np.zeros(len(rows) + 1, np.uint64)
    np.cumsum(mix(hashes[order]), out=sums[1:])
    return mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)


def _texts(docs: DataFrame, key: str, text: str, like: Likeness, wanted: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the classes in ``wanted`` (``key``, ``node``), taken from the class's first row."""
    # by key, which spreads the copies; a key that has several texts needs the class as well
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.join(wanted, F.col("key").eqNullSafe(F.col("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = byte_weights(True)
        for batch in batches:
            for block, rows, hashes in _sets(batch.column(1), like.words, weights):
                part = batch.slice(block.first, block.rows)
                yield part.filter(pa.array(_nodes(part, rows, hashes) == part.column(0).to_numpy()))

    return found.select("node", "text").mapInArrow(run, "node bigint, text string").dropDuplicates(["node"])


def _checked(docs, key, text, like, classes, pairs, scratch) -> DataFrame:
    """The candidate pairs that link, by their texts, which are dropped when that is known."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.store(classes.join(nodes, "node", "left_semi").select("node", "label"), "wanted")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    held = scratch.store(_texts(docs, key, text, like, wanted), "texts")
    both = pairs.select("a", "b").join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    linked = scratch.store(exact(both, like), f"linked-{len(scratch.paths)}")
    scratch.empty("texts")
    return linked


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()):  # noqa: B008
    """Rows with their class, and the component of each class that is like another.

    Returns ``key``, ``node``, ``n`` for every row (``n`` 0: no shingles, no
    class), and ``node``, ``component``. Classes that can reach each other by
    likeness are those of one component.
    """
    spark = docs.sparkSession
    wanted = CELLS_A_DOCUMENT * max(1, docs.count())
    bits = min(MOST_BITS, max(LEAST_BITS, int(wanted - 1).bit_length()))
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, text, like.words, bits))
    scratch = Scratch(spark)
    rows = scratch.store(describe(docs, key, text, like, sketch), "sets")
    classes = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("label"), F.count("*").alias("copies"))
    classes = scratch.store(classes, "classes")

    entries = scratch.store(_entries(rows, classes), "entries")
    # without the leading shingles, which the entries have
    rows = scratch.store(rows.select("key", "node", "n"), "rows")
    scratch.empty("sets")
    stars = scratch.store(_stars(entries), "stars")
    links = _checked(docs, key, text, like, classes, stars, scratch)
    # again with other central classes, for those that are not like the first ones
    joined = connected_components(links)
    unjoined = scratch.store(_unjoined(entries, joined, like), "unjoined")
    scratch.empty("entries")
    again = scratch.store(_other_stars(unjoined), "again")
    if not again.isEmpty():
        joined = extended(joined, _checked(docs, key, text, like, classes, again, scratch))
    # what has fallen away stays away when more is joined
    left = scratch.store(_unjoined(unjoined.drop("component"), joined, like), "left")
    scratch.empty("unjoined")
    pairs = scratch.store(_product(left, like), "pairs")
    scratch.empty("left")
    if not pairs.isEmpty():
        joined = extended(joined, _checked(docs, key, text, like, classes, pairs, scratch))
    return rows, joined


def _entries(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Leading entries of the incidence matrix, one row of documents for each class, in columns of two or more."""
    # of the rows of a class the one with the smallest key stands for it; repeated rows are told apart by nothing, and
    # their entries by nothing either: they are dropped as duplicates
    single = rows.where("n > 0").join(classes.withColumnRenamed("node", "c"), (F.col("node") == F.col("c")) & F.col("key").eqNullSafe(F.col("label")), "left_semi")
    each = single.select("node", "n", "common", F.posexplode(F.arrays_zip("leading", "seen")).alias("pos", "e"))
    each = each.select("node", "n", "common", "pos", F.col("e.leading").alias("gram"), F.col("e.seen").alias("seen"))
    part = F.pmod(F.col("node"), F.ceil(F.col("seen") / COLUMN)).alias("part")
    each = each.select("gram", part, "node", "n", "common", "pos", (F.col("seen") > COLUMN).alias("cut"))
    group = F.struct("common", "node", "n")
    centre = F.max(group).over(_column())
    least, most = F.min("node").over(_column()), F.max("node").over(_column())
    out = each.withColumns({"centre": centre, "several": least < most}).where("several or cut")
    return out.select("gram", "part", "cut", "node", "n", "common", "pos", F.col("centre.node").alias("centre"))


def _column():
    return Window.partitionBy("gram", "part")


def _stars(entries: DataFrame) -> DataFrame:
    """For each class the central class that it shares most leading shingles with; centres of a cut column among themselves."""
    votes = entries.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("shared"))
    best = votes.groupBy("node").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre"))
    over = entries.where("cut").groupBy("gram").agg(F.max(F.struct("common", "centre")).alias("top"))
    parts = entries.where("cut and node = centre").select("gram", F.col("centre").alias("node")).join(over, "gram")
    parts = parts.groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.centre").alias("centre"))
    pairs = best.unionByName(parts).where("node <> centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _unjoined(entries: DataFrame, joined: DataFrame, like: Likeness) -> DataFrame:
    """Entries with their component that may be the first that two classes of different components share.

    Before that first one, each class has no more entries than may differ
    between sets of these sizes. Columns that lie within one component have
    nothing left to multiply.
    """
    placed = entries.join(joined, "node", "left").select("gram", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    for _ in range(2):  # what falls away leaves other columns within one component
        spread = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least")).where("x < y")
        placed = placed.join(spread.select("gram", "least"), "gram").withColumn("least", F.greatest("least", F.expr(like.smallest("n"))))
        placed = placed.where(f"pos <= n - {like.least_overlap('n', 'least')}").drop("least")
    return placed.distinct()


def _other_stars(placed: DataFrame) -> DataFrame:
    """For each class, of each of some pseudorandom centres of its columns, that of another component it shares most with."""
    turns = [F.max(F.struct(F.xxhash64(F.lit(i), "node").alias("draw"), F.col("node").alias("centre"), F.col("component").alias("other"))) for i in range(CENTRES)]
    centres = placed.groupBy("gram").agg(F.array(*turns).alias("centres"))
    own = F.col("component")
    met = F.filter("centres", lambda x: x["other"] != own)
    votes = placed.join(centres, "gram").select("node", F.explode(met).alias("c")).groupBy("node", "c.draw", "c.centre").agg(F.count("*").alias("shared"))
    ranked = Window.partitionBy("node").orderBy(F.desc("shared"), "draw")
    best = votes.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= CENTRES)
    return best.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _product(placed: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of classes that are not joined and whose leading shingles overlap enough for their sizes."""
    # blocks of set sizes: a set that links to a smaller one is in its block or the next
    block = F.floor(F.log("n") / float(np.log(like.over / like.under)))
    small = placed.select("gram", "node", "n", "pos", "component", F.explode(F.array(block, block + 1)).alias("block"))
    large = placed.select("gram", block.alias("block"), *(F.col(x).alias(f"{x}_y") for x in ("node", "n", "pos", "component")))
    least = like.least_overlap("n", "n_y")
    met = small.join(large, ["gram", "block"]).where(
        f"component <> component_y and (n < n_y or n = n_y and node < node_y) and {like.over} * n >= {like.under} * n_y "
        f"and pos <= n - {least} and pos_y <= n_y - {least}"
    )
    counts = met.groupBy(F.col("node").alias("a"), F.col("node_y").alias("b"), "n", "n_y").agg(F.count("*").alias("shared"), F.max("pos").alias("p"), F.max("pos_y").alias("q"))
    # beyond the last shared entry, at most the smaller rest is shared as well
    return counts.where(f"shared + least(n - 1 - p, n_y - 1 - q) >= {least}").select("a", "b")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """``key``, ``n_shingles`` and ``component_id`` (the smallest key that links reach) for every row."""
    rows, joined = similar_classes(docs, key, text, like)
    placed = rows.where("n > 0").join(joined, "node", "left").select("key", "n", F.coalesce("component", "node").alias("c"))
    placed = placed.select("key", "n", "c")
    least = placed.groupBy("c").agg(F.min("key").alias("component_id"), F.count("*").alias("size"))
    # single rows are their own component; only larger ones need the join
    found = placed.join(least.where("size > 1").select("c", "component_id"), "c", "left")
    alone = rows.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    out = found.select("key", "n", F.coalesce("component_id", "key").alias("component_id")).unionByName(alone)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that have the smallest key of their group, one for each group, and all without shingles.

    Rows that repeat a key and its shingle set are one group, of which one row stays.
    """
    rows, joined = similar_classes(docs, key, text, like)
    placed = rows.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = placed.groupBy("c").agg(F.min("key").alias("least"), F.count("*").alias("size")).where("size > 1")
    kept = placed.join(least, "c", "left").where("n = 0 or size is null or key <=> least").groupBy("key", "node").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    kept = stored(kept, "kept")
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    found = wide.join(kept, F.col(f"doc.`{key}`").eqNullSafe(F.col("key"))).select("node", F.col(f"doc.`{text}`").alias("text"), "n", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = byte_weights(True)
        for batch in batches:
            for block, rows, hashes in _sets(batch.column(1), like.words, weights):
                part = batch.slice(block.first, block.rows)
                yield part.filter(pa.array(_nodes(part, rows, hashes) == part.column(0).to_numpy())).select(["node", "n", "doc"])

    schema = T.StructType([T.StructField("node", T.LongType()), found.schema["n"], found.schema["doc"]])
    one = found.mapInArrow(run, schema)
    if not kept.where("copies > 1 and n > 0").isEmpty():
        # rows without shingles have the same node, but are no copies of each other
        alone = one.where("n = 0")
        one = one.where("n > 0").withColumn("key", F.col(f"doc.`{key}`")).dropDuplicates(["key", "node"]).drop("key").unionByName(alone)
    return one.select("doc.*")
