"""Mixing sources to target weights, in fixed-length blocks of words.

The texts of a source, in an order set by hashes, are one stream of words, cut
into blocks of fixed length. The mix is a sequence of slots in shards. For
every shard, source counts are drawn from the multinomial distribution of the
targets: each slot draws a ticket, and sources own ranges of tickets. The few
slots by which the draws of a source exceed its target go to sources that were
drawn too rarely, so that every source meets its target. The slots of a source
are numbered across shards, and its pseudorandom permutation maps a number to
a block; after the last block it begins anew. Blocks are joined by index.

All of it is DataFrame expressions. Running sums are taken in steps over
chunks of a bounded number of rows, so that a source with a third of all texts
is not summed up in one task. Draws and permutations are hashes with a fixed
seed and keys, so reruns agree.

Nulls: a null text has size 0, a null source comes after all others, a null
key is a key like others. Rows equal in every column are texts of their own,
with equal hashes; which of them is taken how often is the same for every run
as a whole. Texts without words are never taken. An empty table gives an empty
mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjrank.operators import global_index
from adjrank.session import cut, scratch_path, stored

#: Fixed by the contract: weights of the sources in their order, and the size of the mix.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, slots in a shard, rows of a chunk that is summed up by one task.
BLOCK, SHARD, CHUNK = 64, 1024, 4096
ROUNDS = 8
#: A table of sources that has no more rows is broadcast.
FEW = 50_000
SEED = 20
#: Hashes that set the order of a source's stream have so many bits.
BITS = 62


def running(df: DataFrame, group: str, place: str, order: list, value: str, largest: int, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of ``group`` that come before, by ``place`` and then ``order``.

    ``place`` is a bigint from 0 to ``largest``; chunks of neighbouring places
    are summed first and their sums by the same method, so no task sums up
    more than a chunk's rows.
    """
    if largest < CHUNK:
        window = Window.partitionBy(group).orderBy(place, *order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0).cast("long")))
    bits, chunk, own = CHUNK.bit_length() - 1, f"{place}_chunk", f"{name}_own"
    placed = df.withColumn(chunk, F.shiftright(place, bits))
    sums = placed.groupBy(group, chunk).agg(F.sum(value).alias("sum"))
    sums = running(sums, group, chunk, [], "sum", largest >> bits, f"{name}_base").select(group, chunk, f"{name}_base")
    window = Window.partitionBy(group, chunk).orderBy(place, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn(own, F.coalesce(F.sum(value).over(window), F.lit(0).cast("long"))).join(sums, [group, chunk])
    return out.withColumn(name, F.col(own) + F.col(f"{name}_base")).drop(chunk, own, f"{name}_base")


def sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``key``, ``source``, ``size`` in words and ``spot``, a hash of the whole row that sets the order."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), spot(docs.columns).alias("spot"))


def spot(columns: list[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *(F.col(f"`{c}`") for c in columns)), 64 - BITS)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to sources (``place`` from 0, ``source_size``).

    Sources share ``share`` times all sizes by weight and stop at ``most``
    times their size; the excess is shared anew until none is above. Each turn
    needs two sums over the sources.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut(sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        over = F.col("limit") <= F.col("weight") * level
        now = rows.agg(
            F.sum(F.when(over, F.col("limit"))).alias("held"), F.count(F.when(over, 1)).alias("n"), F.sum(F.when(~over, F.col("weight"))).alias("free")
        ).first()
        if now["n"] == stopped or not now["free"]:
            break
        level, stopped = (total - (now["held"] or 0)) / now["free"], now["n"]
    return rows.withColumn("target", F.least("limit", F.col("weight") * level))


def holders(tickets: DataFrame, ranges: DataFrame, total: int, columns: list[str]) -> DataFrame:
    """Join each ``ticket`` with the range ``low`` <= ticket < ``high`` that holds it.

    Ranges are cut at the borders of 4096 stretches of tickets, and both sides
    meet by stretch.
    """
    stretch = max(1, -(-total // 4096))
    parts = F.sequence(F.expr(f"low div {stretch}L"), F.expr(f"(high - 1) div {stretch}L"))
    cut_up = ranges.where("high > low").select("low", "high", *columns, F.explode(parts).alias("stretch"))
    inside = (F.col("ticket") >= F.col("low")) & (F.col("ticket") < F.col("high"))
    return tickets.withColumn("stretch", F.expr(f"ticket div {stretch}L")).join(cut_up, "stretch").where(inside).drop("stretch")


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 to ``size`` - 1 for each ``key``: swap or not, in rounds.

    A round pairs an index with its mirror image about a random point and
    swaps the two or not, by a hash of the larger; so it maps one to one.
    """

    def swap(x: Column, turn: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, turn), size) - x, size)
        return F.when(F.xxhash64(F.lit(SEED + 1), key, turn, F.greatest(x, mirror)) % 2 == 0, mirror).otherwise(x)

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), index, swap)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of which ``rows`` rows are known, to be broadcast if these are few."""
    return F.broadcast(df) if rows <= FEW else df


class Mix:
    """A mix of documents: ``rows`` (texts), ``sources`` and ``taken`` blocks."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK):
        spark = docs.sparkSession
        self.block = block
        path = scratch_path(spark, "sizes")
        sized(docs, key, source, text).write.parquet(path)
        rows = spark.read.parquet(path)
        sums = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
        placed = global_index(sums, [F.asc_nulls_last("source")]).withColumnRenamed("pos", "place")
        sources = targets(placed)
        blocks = F.ceil(F.col("source_size") / block)
        # as many slots as blocks of this source's mean length come nearest to its target
        slots = F.when(blocks > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
        sources = sources.withColumns({"blocks": blocks, "slots": slots})
        number = sources.count()
        sources = running(sources.withColumn("all", F.lit(0)), "all", "place", [], "slots", number, "low")
        self.sources = cut(sources.drop("all"))
        self.number, self.total = number, self.sources.agg(F.sum("slots")).first()[0] or 0
        # the stream of each source
        n = rows.count()
        named = bounded(self.sources.select(F.col("source").alias("s"), "place", "source_size", "target"), number)
        known = rows.join(named, F.col("source").eqNullSafe(F.col("s")))
        chunks = max(1, -(-n // (CHUNK // 4)))  # places so that a chunk of them has a quarter of CHUNK rows
        places = 1 << min(BITS, (chunks * CHUNK - 1).bit_length())
        scaled = F.shiftrightunsigned("spot", BITS - (places.bit_length() - 1))
        known = known.drop("s").withColumn("at", scaled)
        path = scratch_path(spark, "streams")
        running(known, "place", "at", ["spot", "size"], "size", places - 1, "start").drop("at").write.parquet(path)
        self.rows = spark.read.parquet(path)

    def slots(self) -> DataFrame:
        """Every slot of the mix: ``slot``, ``shard``, ``place`` of its source and the ``block`` it takes."""
        spark = self.rows.sparkSession
        if not self.total:
            return spark.range(0).select(F.col("id").alias("slot"), F.col("id").alias("shard"), F.col("id").alias("place"), F.col("id").alias("block"))
        own = self.sources.withColumn("high", F.col("low") + F.col("slots"))
        drawn = spark.range(self.total).select(
            F.col("id").alias("slot"),
            F.shiftright("id", SHARD.bit_length() - 1).alias("shard"),
            F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("id")), F.lit(self.total)).alias("ticket"),
        )
        drawn = holders(drawn, own, self.total, ["place"]).select("slot", "shard", "place")
        # numbers of a source's slots, across shards
        counts = drawn.groupBy("place", "shard").agg(F.count("*").alias("drawn"))
        path = scratch_path(spark, "draws")
        running(counts, "place", "shard", [], "drawn", self.total // SHARD, "base").write.parquet(path)
        counts = spark.read.parquet(path)
        within = Window.partitionBy("place", "shard").orderBy("slot")
        numbered = drawn.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["place", "shard"])
        numbered = numbered.select("slot", "shard", "place", (F.col("base") + F.col("rank")).alias("number"))
        # slots beyond a source's target go to sources that lack some
        sums = counts.groupBy("place").agg(F.sum("drawn").alias("drawn"))
        sums = self.sources.select("place", "slots", "blocks").join(sums, "place", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        sums = sums.withColumns({"over": F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), "lack": F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))})
        sums = running(sums.withColumn("all", F.lit(0)), "all", "place", [], "over", self.number, "over_low")
        sums = cut(running(sums, "all", "place", [], "lack", self.number, "low").withColumn("high", F.col("low") + F.col("lack")))
        numbered = stored(numbered.join(bounded(sums.select("place", "slots", "blocks", "over_low"), self.number), "place"), "numbered")
        kept = numbered.where("number < slots").select("slot", "shard", "place", "number", "blocks")
        moved = numbered.where("number >= slots").select("slot", "shard", (F.col("over_low") + F.col("number") - F.col("slots")).alias("ticket"))
        moved = holders(moved, sums.select("low", "high", F.col("place"), F.col("blocks"), F.col("drawn")), max(1, self.total), ["place", "blocks", "drawn"])
        moved = moved.select("slot", "shard", "place", (F.col("drawn") + F.col("ticket") - F.col("low")).alias("number"), "blocks")
        slots = kept.unionByName(moved)
        return slots.select("slot", "shard", "place", permuted(F.col("number") % F.col("blocks"), F.col("blocks"), F.col("place")).alias("block"))

    def pieces(self) -> DataFrame:
        """Each text's part of each block, with how many ``times`` the mix takes it.

        A text is known by its ``place`` and ``start``; ``first`` is the part's first word in the text.
        """
        end = F.col("start") + F.col("size")
        spans = F.sequence(F.expr(f"start div {self.block}L"), F.expr(f"(start + size - 1) div {self.block}L"))
        cut_up = self.rows.where("size > 0").select("place", "start", end.alias("end"), F.explode(spans).alias("block"))
        low = F.greatest("start", F.col("block") * self.block)
        high = F.least("end", (F.col("block") + 1) * self.block)
        cut_up = cut_up.select("place", "block", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"))
        times = self.slots().groupBy("place", "block").agg(F.count("*").alias("times"))
        return cut_up.join(times, ["place", "block"])

    def taken(self) -> DataFrame:
        """``key``, ``size``, ``source_size``, ``target`` and ``taken`` words for each row."""
        words = self.pieces().groupBy("place", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        # texts without words share their start with the text after them, and take nothing
        start = F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.pmod("spot", F.lit(1 << 40)))
        rows = self.rows.withColumn("start", start)
        return rows.join(words, ["place", "start"], "left").select(
            "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
        )

    def documents(self, docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
        """The texts of the mix, with all columns of ``docs``, from which it was made.

        A text that is taken whole once or twice comes so often, as it is; of
        one that is taken in part comes a text of the words taken.
        """
        twice = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn")
        part = F.struct("first", "words")
        parts = self.pieces().select("place", "start", "first", "words", twice).groupBy("place", "start", "turn").agg(
            F.array_sort(F.collect_list(part)).alias("parts"), F.sum("words").alias("held")
        )
        plan = parts.join(self.rows.where("size > 0").select("place", "start", "size", "spot"), ["place", "start"])
        plan = stored(plan.select("spot", "parts", (F.col("held") == F.col("size")).alias("whole")), "plan")
        # rows with the same hash are equal, so any of them has the text of all
        texts = docs.select(spot(docs.columns).alias("spot"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
        found = texts.dropDuplicates(["spot"]).join(plan, "spot")
        own = F.col(f"doc.`{text}`")
        words = F.filter(F.split(own, r"[\x20\x09-\x0D]+"), lambda x: x != "")
        found = found.withColumn("words", F.when(~F.col("whole"), words))
        some = F.flatten(F.transform("parts", lambda x: F.slice("words", x["first"].cast("int") + 1, x["words"].cast("int"))))
        found = found.withColumn("text", F.when(F.col("whole"), own).otherwise(F.array_join(some, " ")))
        new = {text: F.col("text")}
        if chars in docs.columns:
            new[chars] = F.length("text").cast(docs.schema[chars].dataType)
        return found.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
