"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import encode, partitions, shingle_hashes, span_hashes, word_spans

K = 128
WIDTH = 5


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k smallest distinct hashes (unsigned, ascending) of a text's word shingles, ASCII letters lower-cased.

    Fewer than `width` words make one shingle; a text without words (null, empty) has an empty sketch.
    A sketch of under k hashes holds all of the text's shingles.
    """
    buf = encode(text).lower()
    hashes = shingle_hashes(span_hashes(buf, *word_spans(buf)), width)
    if len(hashes) > 8 * k:  # repeats can hide distinct hashes, so the cut-off takes more than k
        cut_off = np.partition(hashes, 4 * k)[4 * k]
        low = np.unique(hashes[hashes <= cut_off])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two texts' shingles together; associative, commutative, idempotent."""
    return np.union1d(a, b)[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact where the sketch is not full."""
    return float(len(s)) if len(s) < k else (k - 1) / (float(s[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty ones, 0 for one."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return len(np.intersect1d(np.intersect1d(both, a, True), b, True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    size = distinct(a, k)
    return 1.0 if not size else min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / size)


def text_form(s: np.ndarray) -> str:
    """Count of hashes, then their upper 48 bits in base64."""
    raw = s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return f"{len(s)}:{base64.b64encode(raw).decode()}"


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(id, sketch array<long>): hashes less 2**63, so that signed order is their order; a row for each row of docs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "sketch": [(sketch(t, k, width) ^ np.uint64(1 << 63)).view(np.int64) for t in batch["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, sketch array<long>")


def merged(sketched: DataFrame, by: list[str | Column], k: int = K) -> DataFrame:
    """One sketch a group. Each hash is first taken once a group, in partial aggregation, and then only ranks up to k go on.

    The group may hold any share of all rows: it is ranked in parts, k hashes a part, before the parts meet.
    """
    one = sketched.select(*by, F.explode("sketch").alias("_h")).distinct()
    names = one.columns[:-1]
    parts = one.withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy(*names, "_part").orderBy("_h"))
    few = parts.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
    last = F.row_number().over(Window.partitionBy(*names).orderBy("_h"))
    return few.withColumn("_r", last).filter(F.col("_r") <= k).groupBy(*names).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def _half(text: str, nxt: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + nxt[:n]


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _rows(items: list[tuple]) -> pd.DataFrame:
    """Output rows of (id, text, sketch, next text, next sketch)."""
    out = []
    for key, text, own, nxt, after in items:
        edited = _half(text, nxt)
        other = own if edited == text else sketch(edited)
        out.append((key, len(text), hashlib.sha256(encode(edited)).hexdigest(), text_form(own), text_form(other),
                    resemblance(own, other), resemblance(own, after)))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
    return frame.astype({"doc_id": "Int64"})


#: What documents are ordered by: rows without an id first, then by id, by the text's first seven bytes, by its hash.
_ORDER = ("named", "id", "head", "hash")


def _ordered(docs: DataFrame) -> DataFrame:
    """docs with the columns of _ORDER, which tell any two rows of different id or text apart, and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.conv(F.hex(F.rpad(F.substring(F.encode(text, "UTF-8"), 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("long")
    key = F.col("doc_id").cast("long")
    return docs.select(F.when(key.isNull(), 0).otherwise(1).alias("named"), F.coalesce(key, F.lit(0)).alias("id"), head.alias("head"),
                       F.xxhash64(text).alias("hash"), text.alias("text"))


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """At most parts - 1 ascending values of _ORDER that cut rows into ranges of about equal size.

    Quantiles of the id are taken first; an id that fills several ranges is cut by its texts. They decide on
    sizes alone, and are constants from here on: the row's range is the same whenever it is computed.
    """
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    first = rows.agg(F.percentile_approx(F.struct("named", "id").getField("id"), cuts, 100 * parts).alias("q")).first()["q"] or []
    out: set[tuple] = set()
    times = {i: first.count(i) for i in set(first)}
    out.update((1, i, -1, -(1 << 63)) for i, n in times.items() if n == 1)
    crowded = {i: n for i, n in times.items() if n > 1}
    if crowded:
        most = max(crowded.values())
        inside = rows.filter(F.col("id").isin(list(crowded))).groupBy("named", "id").agg(
            F.percentile_approx("head", [i / (most + 1) for i in range(1, most + 1)], 100 * most).alias("q"), F.percentile_approx(
                "hash", [i / (most + 1) for i in range(1, most + 1)], 100 * most).alias("h"))
        for r in inside.collect():
            heads = {h: r["q"].count(h) for h in set(r["q"])}
            out.update((r["named"], r["id"], h, -(1 << 63)) for h in heads)
            # Texts with one beginning are cut by their hash.
            out.update((r["named"], r["id"], h, x) for h, n in heads.items() if n > 1 for x in r["h"][:: max(1, most // n)])
    return sorted(out)


def _ranged(rows: DataFrame, parts: int) -> DataFrame:
    """rows with the number of their range in the column bucket."""
    bounds = _bounds(rows, parts)

    def place(named: pd.Series, key: pd.Series, head: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, x) for x in zip(named.tolist(), key.tolist(), head.tolist(), hashed.tolist(), strict=True)], dtype="int32")

    return rows.withColumn("bucket", F.pandas_udf(place, "int")(*_ORDER))


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of each range but its last, each with the one after it; a partition holds whole ranges in order."""
    held, at = None, None
    for batch in batches:
        items = []
        for named, key, bucket, text in zip(batch["named"].tolist(), batch["id"].tolist(), batch["bucket"].tolist(), batch["text"], strict=True):
            now = (key if named else None, text, sketch(text))
            if held and bucket == at:
                items.append((*held, *now[1:]))
            held, at = now, bucket
        yield _rows(items)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _rows([(k if n else None, t, sketch(t), x, sketch(x)) for n, k, t, x in zip(batch["named"], batch["id"], batch["text"], batch["after"], strict=True)])


def op4_sketch(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each text's fingerprint beside its edited text's and the next document's: a row for each row of docs.

    The documents are cut into ranges of _ORDER at constant bounds; one exchange brings each range together,
    where rows are paired in order. Of each range the first and the last row's values of _ORDER pass through
    the driver, which pairs the ranges (one row each). Null texts are empty; rows without an id come first;
    rows that share an id go by text as _ORDER says, and any number of them may: they fill several ranges.
    Equal rows follow one another. A single document is its own next one; an empty table gives an empty
    result; other columns are not looked at.
    """
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    rows = _ranged(_ordered(docs), parts)
    sorted_rows = rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", *_ORDER)
    inside = sorted_rows.select("named", "id", "bucket", "text").mapInPandas(_within, _OUT)
    key = F.struct(*_ORDER)
    ends = sorted(rows.groupBy("bucket").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect(), key=lambda r: r["bucket"])
    pairs = [(*r["high"], *ends[(i + 1) % len(ends)]["low"]) for i, r in enumerate(ends)]
    schema = ", ".join(f"{c}{s} {t}" for s in ("", "_next") for c, t in zip(_ORDER, ("int", "long", "long", "long"), strict=True))
    wanted = spark.createDataFrame(pairs, schema)
    marks = wanted.select(*_ORDER).union(wanted.select(*[f"{c}_next" for c in _ORDER])).distinct()
    texts = _ordered(docs).join(F.broadcast(marks), list(_ORDER), "left_semi").groupBy(*_ORDER).agg(F.max("text").alias("text"))
    after = texts.select(*[F.col(c).alias(f"{c}_next") for c in _ORDER], F.col("text").alias("after"))
    across = wanted.join(texts, list(_ORDER)).join(after, [f"{c}_next" for c in _ORDER]).select("named", "id", "text", "after")
    return inside.unionByName(across.mapInPandas(_across, _OUT))
