"""Lines of large text files: numbered, counted and put together by many tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.operators.graph import cut

#: Rows of a piece are 2 ** PIECE_BITS values of the order at most.
PIECE_BITS = 14


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, from 0; a large file is read in byte ranges by many tasks.

    Each range numbers its own lines; how many lines the ranges before it have is summed up over one row a
    range. The lines are kept once, as a second reading might cut the files in other places.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mark"), "value")
    kept = cut(read)
    ranges = kept.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("mark").alias("low"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")
    starts = ranges.select("file", "at", "low", before.alias("start"))
    return kept.join(starts, ["file", "at"]).select("file", (F.col("start") + F.col("mark") - F.col("low")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def running(rows: DataFrame, sums: dict[str, Column], by: str = "file", order: str = "line_no", ahead: bool = False) -> DataFrame:
    """rows with running sums over `order` (whole numbers, no two alike) within `by`; with ahead, the next row is counted in too.

    A group of any size is summed in pieces of bounded size, which start from the sums of the pieces before
    them: one row a piece goes through a window over the group.
    """
    piece, names = "_piece", list(sums)
    parts = rows.withColumns({piece: F.shiftright(order, PIECE_BITS), **{f"_{n}": c.cast("long") for n, c in sums.items()}})
    totals = parts.groupBy(by, piece).agg(*[F.sum(f"_{n}").alias(f"_t_{n}") for n in names], F.min_by(F.struct(*[F.col(f"_{n}") for n in names]), order).alias("_first"))
    over = Window.partitionBy(by).orderBy(piece)
    starts = totals.select(by, piece, *[(F.sum(f"_t_{n}").over(over) - F.col(f"_t_{n}")).alias(f"_s_{n}") for n in names], F.lead("_first").over(over).alias("_next"))
    within = Window.partitionBy(by, piece).orderBy(order)
    joined = parts.join(starts, [by, piece])
    out = {n: F.col(f"_s_{n}") + F.sum(f"_{n}").over(within) for n in names}
    if ahead:
        out = {n: c + F.coalesce(F.lead(f"_{n}").over(within), F.col(f"_next._{n}"), F.lit(0)) for n, c in out.items()}
    return joined.withColumns(out).drop(piece, "_next", *[f"_{n}" for n in names], *[f"_s_{n}" for n in names])
