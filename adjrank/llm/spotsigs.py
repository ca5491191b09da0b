"""SpotSigs: signatures of content words that follow common words.

An anchor is a run of common words; its signature is the anchor and the next
content words, further common words skipped. Text that is mostly furniture has
few of them, so signatures describe the prose. A fingerprint is the sorted set
of a text's signatures, each as eight hexadecimal digits of its hash; the
likeness of two is the Jaccard similarity of these sets.

Everything is built from Spark's own expressions. Anchors are glued to what
follows by one regular expression, so that splitting the text gives the
content words, each with its anchors before it.

A text with words but no complete signature has one of its whole word
sequence; a text without words, or null, has none, and its fingerprint is
empty. Two empty fingerprints are alike, an empty and another one not at all.
Null keys come last in the order of documents; rows that repeat a key follow
each other, by a hash of their texts. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjrank.operators import global_index
from adjrank.session import cut

#: Fixed: common words of English, French, German and Spanish that anchor signatures.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au ce dans des du en est et la le les par pas pour que qui un une "
    "das der die ein eine ist nicht und von zu "
    "con de del el los las no por se su una y"
).split()
#: Content words in a signature.
CHAIN = 2
#: Glues anchors to the word after them; cleaned texts don't have it.
GLUE = "\x01"
#: The order of documents is cut into buckets of about so many rows, and into so many at most.
ROWS, BUCKETS = 64, 1 << 16
#: A bucket that is so many times larger than planned shows that keys are uneven.
UNEVEN = 32


def cleaned(text: Column) -> Column:
    """The text's runs of letters and digits in lower case, a space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def with_signatures(df: DataFrame, text: str, name: str, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted distinct 32-bit signatures of a text column, as ``array<bigint>``.

    In steps, each of which Spark evaluates once a row.
    """
    glue = F.regexp_replace("_clean", r"(?<![^ ])(" + "|".join(anchors) + ") ", "$1" + GLUE)
    tokens = F.col("_tokens")
    n = F.greatest(F.size(tokens) - (chain - 1), F.lit(0))
    spots = F.transform(F.slice(tokens, F.lit(1), n), lambda x: F.when(F.contains(x, F.lit(GLUE)), x))
    for j in range(1, chain):
        after = F.slice(tokens, F.lit(j + 1), n)
        spots = F.zip_with(spots, after, lambda x, y: F.concat(x, F.lit(" "), F.substring_index(y, GLUE, -1)))
    whole = F.when(F.col("_clean") != "", F.array("_clean")).otherwise(F.array().cast("array<string>"))
    found = F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(whole)
    hashed = F.transform(found, lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (
        df.withColumn("_clean", cleaned(F.col(text)))
        .withColumn("_tokens", F.split(glue, " "))
        .withColumn("_spots", F.filter(spots, lambda x: x.isNotNull()))
        .withColumn(name, F.array_sort(F.array_distinct(hashed)))
        .drop("_clean", "_tokens", "_spots")
    )


def fingerprint(signed: Column) -> Column:
    """Signatures as one string."""
    return F.array_join(F.transform(signed, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures, from 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def bucketed(rows: DataFrame, rows_each: int = ROWS, most: int = BUCKETS) -> DataFrame:
    """``key`` and ``text`` with ``bucket``: ranges of the descending order of keys, rising, of bounded size.

    Ranges of equal width if that makes even buckets; else rows are numbered first.
    """
    ends = rows.agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"), F.count("key").alias("keys")).first()
    number = max(1, min(most, -(-ends["n"] // rows_each)))
    if not ends["keys"]:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    width = (ends["most"] - ends["least"]) // number + 1
    # integer division rounds to 0, which keeps the order
    bucket = F.expr(f"-(key div {width}L)") if width < 2**63 else F.lit(0).cast("long")
    wide = rows.withColumn("bucket", F.coalesce(bucket, F.expr(f"1 - ({ends['least']}L div {min(width, 2**63 - 1)}L)")))
    largest = wide.groupBy("bucket").count().agg(F.max("count")).first()[0]
    if largest <= UNEVEN * max(rows_each, ends["n"] // number):
        return wide
    order = [F.desc_nulls_last("key"), F.asc("tie")]
    numbered = global_index(rows.withColumn("tie", F.xxhash64("text")), order, unique=False)
    each = max(rows_each, -(-ends["n"] // most))
    return numbered.select("key", "text", F.expr(f"pos div {each}L").alias("bucket"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text``, its ``signed``, and those of the next row: ``next_text``, ``next_signed``.

    The next row is the one after it by descending key; after the last, the first.
    """
    rows = bucketed(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    heads = rows.groupBy("bucket").agg(F.max("key").alias("head"))
    # no more rows than buckets
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    heads = heads.select("bucket", "head", F.coalesce(F.lag("bucket").over(order), last).alias("before"))
    placed = rows.join(F.broadcast(heads), "bucket")
    # the first row of a bucket follows the last one of the bucket before
    own, other = F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    at = F.explode(F.when(F.col("key").eqNullSafe(F.col("head")), F.array(own, other)).otherwise(F.array(own)))
    spread = placed.select("key", "text", at.alias("at")).select("key", "text", "at.*").repartition("bucket")
    signed = with_signatures(spread, "text", "signed")
    within = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("key"), F.xxhash64("text"))
    found = signed.withColumns({"next_text": F.lead("text").over(within), "next_signed": F.lead("signed").over(within)})
    return found.where("guest = 0").drop("guest", "bucket").withColumnRenamed("key", key).withColumnRenamed("text", text)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (``key``, ``class``) and pairs of classes ``a``, ``b`` with a ``likeness`` of the threshold or more.

    Rows with equal fingerprints are one class. Classes are partitioned by the
    number of their signatures, so that only neighbouring partitions can hold
    alike ones, and meet in one if they share one of their rarest signatures,
    as many as the threshold leaves free to differ. Texts without signatures
    are in no class.
    """
    rows = with_signatures(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "signed").drop("text")
    rows = cut(rows.withColumns({"n": F.size("signed"), "class": F.xxhash64("signed")}))
    classes = cut(rows.where("n > 0").groupBy("class").agg(F.first("signed").alias("signed"), F.first("n").alias("n")))
    entries = classes.select("class", "n", F.explode("signed").alias("sig"))
    seen = entries.groupBy("sig").agg(F.count("*").alias("seen"))
    rarest = Window.partitionBy("class").orderBy("seen", "sig")
    lead = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    leading = entries.join(seen, "sig").withColumn("place", F.row_number().over(rarest)).where((F.col("place") <= lead) & (F.col("seen") > 1))
    part = F.floor(F.log("n") / math.log(1 / threshold))
    small = leading.select("sig", F.explode(F.array(part, part + 1)).alias("part"), F.col("class").alias("a"), F.col("n").alias("n_a"))
    large = leading.select("sig", part.alias("part"), F.col("class").alias("b"), F.col("n").alias("n_b"))
    met = small.join(large, ["sig", "part"]).where(
        (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & ((F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    )
    pairs = met.select("a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("class").alias(side), F.col("signed").alias(f"signed_{side}")), side)
    pairs = pairs.withColumn("likeness", likeness(F.col("signed_a"), F.col("signed_b"))).where(F.col("likeness") >= threshold)
    members = rows.where("n > 0").select(F.col("key").alias(key), "class")
    return members, pairs.select("a", "b", "likeness")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the next document's beginning."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, key, text).select(key, n.cast("long").alias("n_chars"), "signed", "next_signed", edited.alias("edited"))
    rows = with_signatures(rows, "edited", "edited_signed")
    return rows.select(
        key,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signed")).alias("fingerprint"),
        fingerprint(F.col("edited_signed")).alias("edited_fingerprint"),
        likeness(F.col("signed"), F.col("edited_signed")).alias("near_edited"),
        likeness(F.col("signed"), F.col("next_signed")).alias("near_next"),
    )
