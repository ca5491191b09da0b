"""Text sources and sinks: adjacency lines, edge lists, rank vectors, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adjrank.functions.parse import adjacency_line, parse_lines
from adjrank.session import cut, shuffle_partitions

MODES = ("DROPMALFORMED", "FAILFAST", "PERMISSIVE")


def _read_lines(spark: SparkSession, path, mode: str, keyed: bool, names: list[str]) -> DataFrame:
    """Columns ``names`` of the lines, treating malformed ones as ``mode`` says."""
    mode = mode.upper()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    line = F.substring_index("value", "\t", -1) if keyed else F.col("value")
    df = parse_lines(spark.read.text(path), line, "rank" in names)
    malformed = F.col("row").isNull()
    columns = [F.col("row")[name].alias(name) for name in names]
    if mode == "PERMISSIVE":
        return df.select(*columns, F.when(malformed, F.col("value")).alias("_corrupt_record"))
    if mode == "FAILFAST":
        # In the filter, so that the check is not lost when columns are pruned.
        failed = F.raise_error(F.concat(F.lit("malformed adjacency line: "), F.col("value")))
        return df.where(F.when(malformed, failed.cast("boolean")).otherwise(True)).select(*columns)
    return df.where(~malformed).select(*columns)


def read_ranked_adjacency(
    spark: SparkSession, path, mode: str = "DROPMALFORMED", keyed: bool = False
) -> DataFrame:
    """Lines ``src n d1 ... dn rank`` as ``(src, dst, rank)``.

    ``mode`` is that of Spark's own readers; PERMISSIVE adds the malformed line
    as ``_corrupt_record``. ``keyed`` reads only what follows the last TAB.
    """
    return _read_lines(spark, path, mode, keyed, ["src", "dst", "rank"])


def read_adjacency(
    spark: SparkSession, path, mode: str = "DROPMALFORMED", keyed: bool = False
) -> DataFrame:
    """Lines ``src n d1 ... dn`` as ``(src, dst)``; see :func:`read_ranked_adjacency`."""
    return _read_lines(spark, path, mode, keyed, ["src", "dst"])


def read_rank_vector(spark: SparkSession, path) -> DataFrame:
    """Whitespace-separated ``id rank`` lines; lines that do not parse are skipped."""
    tokens = F.split(F.regexp_replace("value", r"^\s+", ""), r"\s+")
    df = spark.read.text(path).withColumn("_tokens", tokens)
    row = F.struct(
        F.get("_tokens", F.lit(0)).try_cast("bigint").alias("id"),
        F.get("_tokens", F.lit(1)).try_cast("double").alias("rank"),
    )
    # Out of a generator, so that the filter does not tokenize a second time.
    return (
        df.select(F.explode(F.array(row)).alias("row"))
        .select("row.*")
        .where("id is not null and rank is not null")
    )


def write_adjacency(adj: DataFrame, path: str, mode: str = "error") -> None:
    """One line ``src n d1 ... dn`` per vertex; segments are put together, see :func:`write_ranked_adjacency`."""
    _write_lines(adj.drop("rank"), path, mode)


def write_ranked_adjacency(ranked: DataFrame, path: str, mode: str = "error") -> None:
    """One line ``src n d1 ... dn rank`` per vertex; segments are put together.

    Vertices with one row are written where they are. The others' rows are
    sorted by segment within their partition and streamed out one by one, in
    files of their own, so no task holds the list of a vertex. The last line of
    such a file ends with a space instead of a line break. These files are
    added by a second job, so ``mode`` decides about ``path`` in the first.
    """
    _write_lines(ranked, path, mode)


def _write_lines(adj: DataFrame, path: str, mode: str) -> None:
    rank = F.col("rank") if "rank" in adj.columns else None
    line = adjacency_line(F.col("src"), F.col("dst"), rank).alias("value")
    several = cut(adj.where("segment > 0").select("src").distinct()) if "segment" in adj.columns else None
    if several is None or several.isEmpty():
        adj.select(line).write.mode(mode).text(path)
        return
    adj.join(several, "src", "left_anti").select(line).write.mode(mode).text(path)
    split = adj.join(several, "src", "left_semi")
    _line_pieces(split).write.mode("append").options(lineSep=" ", maxRecordsPerFile=0).text(path)


def _line_pieces(split: DataFrame) -> DataFrame:
    """The lines of vertices with several rows, a piece for each row, in order; pieces of a partition are joined by spaces.

    A vertex's last row ends its line and has the beginning of the next one, so that no piece begins with a line break.
    """
    ranked = "rank" in split.columns
    parts = shuffle_partitions(split.sparkSession)
    linked = F.when(F.size("dst") > 0, F.col("segment"))
    sizes = split.groupBy("src").agg(
        F.sum(F.size("dst")).alias("n"),
        F.coalesce(F.min(linked), F.max("segment")).alias("start"),
        F.coalesce(F.max(linked), F.max("segment")).alias("last"),
    )
    order = Window.partitionBy("part").orderBy("src")
    begin = F.concat_ws(" ", "src", "n")
    lines = sizes.withColumn("part", F.pmod(F.hash("src"), F.lit(parts))).select(
        "src", "part", "start", "last", F.lead(begin).over(order).alias("ahead"), F.when(F.lag("src").over(order).isNull(), begin).alias("own")
    )
    # one partition for each part, so that a file begins with a part's first line
    pieces = (
        split.join(lines, "src")
        .where((F.size("dst") > 0) | (F.col("segment") == F.col("last")))
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("src", "segment")
    )
    fields = [F.when(F.col("segment") == F.col("start"), F.col("own")), F.when(F.size("dst") > 0, F.array_join("dst", " "))]
    is_last = F.col("segment") == F.col("last")
    if "rank" in split.columns:
        fields.append(F.when(is_last, F.col("rank").cast("string")))
    end = F.when(is_last & F.col("ahead").isNotNull(), F.concat(F.lit("\n"), "ahead")).otherwise("")
    return pieces.select(F.concat(F.concat_ws(" ", *fields), end).alias("value"))


def _write_tabbed(df: DataFrame, columns: tuple[str, str], path: str, mode: str) -> None:
    df.select(*columns).write.mode(mode).csv(path, sep="\t")


def write_edges(edges: DataFrame, path: str, mode: str = "error") -> None:
    """One line ``src TAB dst`` per edge."""
    _write_tabbed(edges, ("src", "dst"), path, mode)


def write_rank_vector(vector: DataFrame, path: str, mode: str = "error") -> None:
    """One line ``id TAB rank`` per vertex; keeps the order of a sorted vector."""
    _write_tabbed(vector, ("id", "rank"), path, mode)


def write_pairs(pairs: DataFrame, path: str, mode: str = "error") -> None:
    """One line ``a TAB b`` per pair."""
    _write_tabbed(pairs, ("a", "b"), path, mode)
