"""Seeded draws as plain integer arithmetic.

Products stay below 2^63, so any SQL engine gives the same values, and a draw
depends only on its arguments, so the result is the same for any partitioning
and any number of task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjrank.functions.blocks import integer_div

# Fixed values of the mixer: the Mersenne prime 2^31 - 1, three multipliers and
# offsets (one per round), the folds between the rounds, and the draw stride.
PRIME = 2147483647
ROUND_1 = (48271, 11)
ROUND_2 = (69621, 7)
ROUND_3 = (40692, 3)
FOLD_12 = 65536
FOLD_23 = 32768
STRIDE = 7919


def _big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _first(value: Column) -> Column:
    return ((value % _big(PRIME)) * ROUND_1[0] + ROUND_1[1]) % _big(PRIME)


def _fold(value: Column, fold: int, factor: int, offset: int) -> Column:
    return ((value + integer_div(value, fold)) * factor + offset) % _big(PRIME)


def with_mixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add the non-negative bigint ``value`` scrambled into ``[0, PRIME)``.

    A column per round: each round names its value twice, and one nested
    expression would grow from round to round.
    """
    mixed = F.col(name)
    df = df.withColumn(name, _first(value))
    return df.withColumn(name, _fold(mixed, FOLD_12, *ROUND_2)).withColumn(name, _fold(mixed, FOLD_23, *ROUND_3))


def mix_all(values: Column) -> Column:
    """The same for every element of an array, one pass per round."""
    values = F.transform(values, _first)
    values = F.transform(values, lambda v: _fold(v, FOLD_12, *ROUND_2))
    return F.transform(values, lambda v: _fold(v, FOLD_23, *ROUND_3))


def with_streams(df: DataFrame, vertex: Column, seed: int, names: list[str]) -> DataFrame:
    """Add the start values of a vertex's independent streams of draws."""
    df = with_mixed(df, "_seeded", vertex + _big(seed % PRIME))
    for number, name in enumerate(names):
        start = F.col("_seeded") + integer_div(vertex, PRIME) + _big(number * STRIDE)
        df = with_mixed(df, name, start)
    return df.drop("_seeded")


def with_distinct_draws(
    df: DataFrame, name: str, vertex: Column, start: Column, count: Column, choices: Column
) -> DataFrame:
    """Add ``count`` distinct values of ``[0, choices)``; all of them when there are fewer.

    A uniform sample without replacement from exactly ``count`` draws: number
    ``i`` is drawn from one value more than number ``i - 1``, and a value that
    was there already is replaced by that new value, which was not.
    A draw has 62 bits, of which the lower half also depends on the vertex itself,
    as streams begin with 31 bits that two of very many vertices may share.
    """
    begin, wanted, drawn = F.col("_begin"), F.col("_wanted"), F.col("_drawn")
    none = F.array().cast("array<bigint>")
    # Columns, so that the lambdas below refer to computed values.
    df = df.withColumn("_choices", choices).withColumn("_begin", start)
    df = df.withColumn("_wanted", F.greatest(F.least(count, F.col("_choices")), F.lit(0).cast("bigint")))
    draws = mix_all(F.transform(F.sequence(_big(1), wanted), lambda i: begin + i * STRIDE))
    lower = (vertex % _big(PRIME)) * ROUND_2[0] + begin
    draws = F.transform(draws, lambda v: v * _big(PRIME) + (v * ROUND_1[0] + lower) % _big(PRIME))
    # The last value draw i may take, for i = 0, 1, …
    draws = F.transform(
        draws, lambda v, i: F.struct(F.col("_choices") - wanted + i, v % (F.col("_choices") - wanted + i + 1))
    )
    df = df.withColumn("_drawn", F.when(wanted > 0, draws))

    def add(picked: Column, draw: Column) -> Column:
        last, value = draw["col1"], draw["col2"]
        return F.array_append(picked, F.when(F.array_contains(picked, value), last).otherwise(value))

    picks = F.when(wanted > 0, F.aggregate(drawn, none, add)).otherwise(none)
    return df.withColumn(name, picks).drop("_begin", "_wanted", "_drawn", "_choices")
