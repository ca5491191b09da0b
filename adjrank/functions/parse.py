"""Parsing and formatting of adjacency lines with built-in expressions.

An adjacency line is ``src n d1 ... dn`` with single spaces; a ranked line has
the rank as its last token. A line is malformed when

* it has fewer than two tokens, or ``src`` or ``n`` is not an integer,
* the number of links to read is negative, or
* it is a ranked line whose last token is not a number.

When fewer than ``n`` links fit on the line, ``tokens - 3`` are read. Reading
stops at the first token that is not an integer; tokens between the last link
and the rank are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"\p{Cntrl}"


def parse_lines(df: DataFrame, line: Column, ranked: bool) -> DataFrame:
    """``value`` and ``row``, the line's ``struct(src, dst[, rank])``; NULL when malformed.

    Every stage is a column of its own, and the row comes out of a generator:
    so a filter on it cannot make Spark parse a second time.
    """
    tokens, src, declared = F.col("_tokens"), F.col("_src"), F.col("_declared")
    wanted, links, whole, rank = F.col("_wanted"), F.col("_links"), F.col("_whole"), F.col("_rank")
    df = df.withColumn("_line", F.rtrim(line))
    # A cast would trim a control character off an integer, which is not one with it.
    visible = F.when(
        F.col("_line").rlike(CONTROL), F.regexp_replace("_line", CONTROL, "?")
    ).otherwise(F.col("_line"))
    df = df.withColumn("_tokens", F.split(visible, " "))
    df = df.withColumn("_src", F.get(tokens, F.lit(0)).try_cast("bigint"))
    df = df.withColumn("_declared", F.get(tokens, F.lit(1)).try_cast("bigint"))
    short = F.size(tokens) - 2 < declared
    df = df.withColumn("_wanted", F.when(short, F.size(tokens) - 3).otherwise(declared).cast("int"))
    read = F.slice(tokens, F.lit(3), F.greatest(wanted, F.lit(0)))
    df = df.withColumn("_links", read.try_cast("array<bigint>"))
    df = df.withColumn("_whole", ~F.exists(links, lambda link: link.isNull()))
    df = df.withColumn("_rank", F.substring_index("_line", " ", -1).try_cast("double"))

    first_bad = F.array_position(F.transform(links, lambda link: link.isNull()), True).cast("int")
    kept = F.when(whole, links).otherwise(F.slice(links, F.lit(1), first_bad - 1))
    fields = [src.alias("src"), kept.alias("dst")]
    good = src.isNotNull() & declared.isNotNull() & (wanted >= 0)
    if ranked:
        fields.append(rank.alias("rank"))
        good &= rank.isNotNull()
    return df.select("value", F.explode(F.array(F.when(good, F.struct(*fields)))).alias("row"))


def adjacency_line(src: Column, dst: Column, rank: Column | None = None) -> Column:
    """Text line of a row, the inverse of the parsers above."""
    fields = [src.cast("string"), F.size(dst).cast("string"), dst.cast("array<string>")]
    if rank is not None:
        fields.append(rank.cast("string"))
    return F.concat_ws(" ", *fields)
