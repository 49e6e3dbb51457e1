"""Limits against hostile exports: what goes beyond them is skipped by name, and the rest is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.sources.records import skips

#: Entries of an export, media of it that can be looked up, folders below one another.
ENTRIES, MEDIA, FOLDERS = 50_000, 20_000, 32
#: Characters of an entry, and objects and lists within one another.
ENTRY_CHARS, NESTING = 1_000_000, 100


def nesting(text: Column) -> Column:
    """How deep the objects and lists of a JSON text go; brackets within strings do not count."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda acc, c: (acc["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now")
    return F.aggregate(F.split(marks, ""), start, lambda acc, c: F.struct(step(acc, c), F.greatest(acc["most"], step(acc, c)).alias("most")), lambda acc: acc["most"])


def fits(text: Column, chars: int = ENTRY_CHARS, depth: int = NESTING) -> Column:
    """Whether an entry is small and shallow enough to be read."""
    return (F.length(text) <= chars) & (nesting(text) <= depth)


def bounded_entries(entries: DataFrame, export: str = "export", entries_limit: int = ENTRIES, folders: int = FOLDERS) -> tuple[DataFrame, DataFrame]:
    """(kept, skips) of an export's entries (export, path): those not too deep, of these the first entries_limit by path.

    Skips name each entry that lies too deep, and each export that has too many once. An export is ranked in
    parts of a bounded number of entries first, so that one of any size is never in one task.
    """
    depth = F.size(F.split("path", "/")) - 1
    shallow, deep = entries.filter(depth <= folders), entries.filter(depth > folders)
    part = F.pmod(F.xxhash64("path"), F.lit(64))
    few = shallow.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy(export, "_part").orderBy("path"))).filter(F.col("_r") <= entries_limit)
    kept = few.withColumn("_r", F.row_number().over(Window.partitionBy(export).orderBy("path"))).filter(F.col("_r") <= entries_limit).drop("_r", "_part")
    many = shallow.groupBy(export).agg(F.count("*").alias("n")).filter(F.col("n") > entries_limit)
    return kept, skips(deep, F.col("path"), "folder lies too deep", "E_DIR_TOO_DEEP").union(skips(many, F.col(export), "export has too many entries", "E_ENTRY_LIMIT"))


def media_index(entries: DataFrame, most: int = MEDIA) -> DataFrame:
    """The entries (export, path) that URIs may name: of each export the first `most` by path."""
    return bounded_entries(entries, entries_limit=most, folders=1 << 20)[0]
