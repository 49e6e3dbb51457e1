"""Transcripts: parsing, word error rates, run tallies, drains."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.text import wer_words

_WHISPER = "struct<result: struct<language: string>, transcription: array<struct<offsets: struct<`from`: long, `to`: long>, text: string>>>"


def parse_transcript(raw: Column) -> Column:
    """struct(text, language, segments) of a transcriber's JSON; segments without text are left out, times are in seconds."""
    j = F.from_json(raw, _WHISPER)
    parts = F.filter(j["transcription"], lambda s: F.trim(s["text"]) != "")
    return F.when(j["transcription"].isNotNull(), F.struct(
        F.array_join(F.transform(parts, lambda s: F.trim(s["text"])), " ").alias("text"), j["result"]["language"].alias("language"),
        F.transform(parts, lambda s: F.struct((s["offsets"]["from"] / 1000.0).alias("start"), (s["offsets"]["to"] / 1000.0).alias("end"), F.trim(s["text"]).alias("text"))).alias("segments")))


#: Bytes of bits that an alignment may keep of its table; beyond it columns are kept at intervals and those between made again.
TABLE_BYTES = 32 << 20


def _columns(heard: list[int], where: dict[int, int], up: int, down: int, full: int, keep: bool) -> tuple[int, int, list[int], list[int]]:
    """The vertical steps (+1 and -1, a bit a reference word) after the columns of `heard`, and what tracing back needs of each.

    A column is one number: bit i of `up` tells that the table rises by one at reference word i, of `down` that
    it falls. All of a column's cells are made at once by carries of an addition (a bit-parallel table).
    """
    level, rising = [], []
    for word in heard:
        same = where.get(word, 0)
        flat = ((((same & up) + up) ^ up) | same | down) & full  # cells that cost no more than their upper left neighbour
        right, left = down | (full & ~(flat | up)), up & flat
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = left | (full & ~(flat | right)), right & flat
        if keep:
            level.append(flat)
            rising.append(up)
    return up, down, level, rising


def align(reference: list[str], heard: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a least-cost alignment; substitutions first among equals, then deletions.

    The table of costs is made a column at a time in bits of whole numbers, and traced back from its end. Of a very
    large table only some columns are kept; the ones between two of them are made again when the trace comes there.
    """
    codes: dict[str, int] = {}
    a, b = ([codes.setdefault(w, len(codes)) for w in words] for words in (reference, heard))
    n, m = len(a), len(b)
    if a == b or not n or not m:
        return 0, n if not m else 0, m if not n else 0
    bits: dict[int, list[int]] = {}
    for i, word in enumerate(a):
        bits.setdefault(word, []).append(i)
    where, room, full = {}, bytearray(-(-n // 8)), (1 << n) - 1
    for word in set(b) & bits.keys():
        for i in bits[word]:
            room[i >> 3] |= 1 << (i & 7)
        where[word] = int.from_bytes(room, "little")
        for i in bits[word]:
            room[i >> 3] = 0
    step = m if n * m // 4 <= TABLE_BYTES else math.isqrt(m) + 1
    at, up, down, kept = 0, full, 0, []
    while at + step < m:
        kept.append((up, down))
        up, down, _, _ = _columns(b[at:at + step], where, up, down, full, False)
        at += step
    kept.append((up, down))
    i, subs, dels, inserts = n - 1, 0, 0, 0
    for block in range(len(kept) - 1, -1, -1):
        part = b[block * step:(block + 1) * step]
        _, _, level, rising = _columns(part, where, *kept[block], full, True)
        j = len(part) - 1
        while i >= 0 and j >= 0:
            if a[i] == part[j]:
                i, j = i - 1, j - 1
            elif not level[j] >> i & 1:
                subs, i, j = subs + 1, i - 1, j - 1
            elif rising[j] >> i & 1:
                dels, i = dels + 1, i - 1
            else:
                inserts, j = inserts + 1, j - 1
        if i < 0:
            return subs, dels, inserts + j + 1 + block * step
    return subs, dels + i + 1, inserts


def word_errors(pairs: DataFrame, reference: str = "reference", heard: str = "heard") -> DataFrame:
    """pairs with words (of the reference), substitutions, deletions, insertions and wer (null without reference words)."""
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["substitutions", "deletions", "insertions"])

    kind = T.StructType([T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions")])
    made = pairs.withColumn("_e", F.pandas_udf(run, kind)(wer_words(F.col(reference)), wer_words(F.col(heard)))).withColumn("words", F.size(wer_words(F.col(reference))))
    errors = F.col("_e.substitutions") + F.col("_e.deletions") + F.col("_e.insertions")
    return made.select(*pairs.columns, "words", "_e.*", (errors / F.nullif("words", F.lit(0))).alias("wer"))


def summary(measured: DataFrame) -> DataFrame:
    """(n, macro_wer, micro_wer, mean_rtf, detection) over rows (words, substitutions, deletions, insertions, wer, rtf, detected)."""
    errors = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    return measured.agg(F.count("*").alias("n"), F.avg("wer").alias("macro_wer"), (errors / F.nullif(F.sum("words"), F.lit(0))).alias("micro_wer"), F.avg("rtf").alias("mean_rtf"),
                        F.avg(F.col("detected").cast("int")).alias("detection"))


def timeout_ms(seconds: Column, floor_ms: int = 120_000, per_second_ms: int = 10_000, cap_ms: int = 7_200_000) -> Column:
    """Time that a clip may take: in proportion to its length, between bounds; the upper bound where it is unknown."""
    return F.when(seconds.isNull(), cap_ms).otherwise(F.least(F.lit(cap_ms), F.greatest(F.lit(floor_ms), (seconds * per_second_ms).cast("long")))).cast("long")


def drain(items: DataFrame, results: DataFrame) -> DataFrame:
    """(id, status) of pending audio and video items by results (id, outcome): done, skipped without speech or sound, failed for any other error."""
    todo = items.filter(F.col("media_type").isin("audio", "video") & (F.col("transcript_status") == "pending"))
    out = F.col("outcome")
    status = F.when(out == "ok", "done").when(out.isin("no-speech", "no-audio"), "skipped").when(out.isin("cancelled", "existing"), None).otherwise("failed")
    return todo.select("id").join(results.select("id", "outcome"), "id").select("id", status.alias("status")).filter("status is not null")


def tally(results: DataFrame) -> DataFrame:
    """How many results there are of each outcome."""
    return results.groupBy("outcome").agg(F.count("*").alias("n"))
