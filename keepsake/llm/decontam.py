"""Benchmark decontamination by template windows, with DataFrame functions alone.

Texts are canonicalised: numbers, names (capitalised words inside a sentence, not words in capitals) and units become typed
placeholders, letters lower case, other marks go. Windows of `width` template words are hash-joined with the
benchmark's; a window that matches but fills its placeholders otherwise counts only if its slots are
consistent over the whole aligned passage: each benchmark value always gives one value in the document and
the other way round, as in a question with new parameters. An item of fewer words is one window of its own
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import broadcast_up_to, cut, fresh

WIDTH = 8
#: A shorter item is looked for as a whole if it has at least so many words; fewer are met by chance.
SHORTEST = 5
#: Words of a window that are no placeholder, and different ones among them, for it to say something.
LITERALS, DIFFERENT = 5, 4
#: Rows of benchmark windows, and of document ids, that may be broadcast (tens of bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000

_SPACE = r"[\x09-\x0D\x20]+"
#: Possessive: Java's engine would put each part of a number that it might give back on the stack.
_NUMBER = r"[+-]?[$€£]?\d++(?:[.,:/]\d++)*+[%°]?"
_NAME = r"(?<=[\p{L}\p{N}\x01,;]\x20)\p{Lu}\p{Ll}[\p{L}\p{M}]*"
_UNIT = (r"(?<=\x01\x20)(?:mm|cm|m|km|mg|g|kg|t|ml|l|s|ms|min|h|hours?|days?|weeks?|months?|years?|minutes?|seconds?|"
         r"miles?|feet|ft|inch(?:es)?|pounds?|lbs?|dollars?|euros?|cents?|percent|degrees?)(?![\p{L}\p{N}])")
#: Marks that are taken out. A word of nothing else goes with its place.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»‘’“”„–—…·´°€£"
_PLACEHOLDERS = ("\x01", "\x02", "\x03")


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(text, _MARKS, ""), _SPACE, " ")), " ")


def template(text: Column) -> Column:
    """The template words of a text; as many as plain() has."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _NUMBER, "\x01"), _NAME, "\x02"), _UNIT, "\x03")
    return _words(F.lower(marked))


def plain(text: Column) -> Column:
    """The words that the template's words stand for: a placeholder takes the place of a word or of a part of one."""
    return _words(F.lower(text))


def _starts(words: Column, width: Column) -> Column:
    n = F.size(words) - width + 1
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _hashes(words: str, width: Column) -> Column:
    """xxhash64 of each window, from hashes of its words."""
    return F.transform(_starts(F.col(words), width), lambda i: F.xxhash64(F.slice(F.col(words), i, width)))


def _sized(width: int) -> Column:
    """(width, place, h) of each window of the column w."""
    return F.transform(_hashes("w", F.lit(width)), lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("place"), h.alias("h")))


def index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(h, item, at, slots, width): the benchmark's windows that say something.

    That is at least LITERALS words that are no placeholder, DIFFERENT ones among them. Items of SHORTEST up to
    `width` words have one window, all of the item.
    """
    worded = benchmark.select(F.col(id_col).alias("item"), template(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).filter("item is not null")
    sized = worded.filter(F.size("t") >= min(SHORTEST, width)).withColumn("width", F.least(F.size("t"), F.lit(width)))
    windows = sized.select("item", "t", "width", F.transform("t", lambda w: F.xxhash64(w)).alias("w")).select(
        "item", "t", "width", F.posexplode(_hashes("w", F.col("width"))).alias("at", "h"))
    window = F.slice(F.col("t"), F.col("at") + 1, F.col("width"))
    literal = F.filter(window, lambda w: ~w.isin(*_PLACEHOLDERS))
    return windows.filter((F.size(literal) >= LITERALS) & (F.size(F.array_distinct(literal)) >= DIFFERENT)).select(
        "h", "item", "at", (F.size(literal) < F.col("width")).alias("slots"), "width").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, item, n_windows): the documents that hold passages of benchmark items, and in how many windows.

    Null, empty and short texts match nothing; a row without an id cannot be named and is passed over; rows
    that share an id are one document. Very long texts are read whole. Items without an id, null ones and those
    of fewer than SHORTEST words or LITERALS literal words are not looked for. Empty tables give no match.
    """
    indexed = cut(index(benchmark, item_col, item_text_col, width))
    # The lengths of windows that the benchmark has: `width`, and fewer where it has shorter items.
    widths = sorted((r["width"] for r in indexed.select("width").distinct().collect()), reverse=True)
    table = broadcast_up_to(indexed, BROADCAST_ROWS)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    hashed = slim.select("id", template(F.col("text")).alias("t")).select("id", F.transform("t", lambda w: F.xxhash64(w)).alias("w"))
    if widths[1:]:
        windows = hashed.select("id", F.explode(F.concat(*map(_sized, widths))).alias("s")).select("id", "s.width", "s.place", "s.h")
    else:
        windows = hashed.select("id", F.lit(width).alias("width"), F.posexplode(_hashes("w", F.lit(width))).alias("place", "h"))
    found = windows.join(table, ["h", "width"])
    hits = cut(found.select("id", "place", "item", "at", "width", (F.col("place") - F.col("at")).alias("shift"), "slots").distinct())
    open_ = hits.filter("slots")
    ids = broadcast_up_to(cut(open_.select("id").distinct()), BROADCAST_ROWS)
    held = slim.join(ids, "id", "left_semi").select("id", template(F.col("text")).alias("t"), plain(F.col("text")).alias("p"))
    items = benchmark.select(F.col(item_col).alias("item"), plain(F.coalesce(F.col(item_text_col), F.lit(""))).alias("b"))
    cuts = lambda words, at: F.slice(F.col(words), F.col(at) + 1, F.col("width"))
    pairs = (open_.join(held, "id").join(items, "item")
             .select("id", "item", "shift", F.explode(F.arrays_zip(cuts("t", "place").alias("t"), cuts("p", "place").alias("p"), cuts("b", "at").alias("b"))).alias("s"))
             .select("id", "item", "shift", "s.t", "s.p", "s.b").filter(F.col("t").isin(*_PLACEHOLDERS)))
    by = ["id", "item", "shift", "t"]
    odd = [pairs.groupBy(*by, one).agg((F.min(other) != F.max(other)).alias("odd")).filter("odd").select("id", "item", "shift")
           for one, other in (("b", "p"), ("p", "b"))]
    good = hits.join(odd[0].union(odd[1]).distinct().withColumn("slots", F.lit(True)), ["id", "item", "shift", "slots"], "left_anti")
    return good.groupBy("id", "item").agg(F.countDistinct("place").alias("n_windows"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """docs without the rows that hold benchmark passages, columns unchanged; rows without an id stay."""
    key = fresh(docs, "_bad")
    bad = broadcast_up_to(cut(matches(docs, benchmark, id_col, text_col, **names).select(F.col("id").alias(key)).distinct()), BROADCAST_ROWS)
    return docs.join(bad, F.col(id_col).cast("long") == F.col(key), "left_anti")


def op10_decontam(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each contaminated document: doc_id, n_windows (that match some item), item_ids (ascending).

    Null, empty, very long and repeated texts, rows without an id, clashing columns and empty tables are as in matches().
    """
    found = matches(docs, benchmark)
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.sum("n_windows").alias("n_windows"), F.sort_array(F.collect_set("item")).alias("item_ids"))
