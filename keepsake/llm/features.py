"""Hashed features of texts, and the bounded samples that classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import encode, mix, span_hashes

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_KIND[ord("A"):ord("Z") + 1] = _LETTER
_KIND[ord("a"):ord("z") + 1] = _LETTER
_KIND[128:] = _LETTER
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
#: Hashes that stand for any number, a word in capitals, and a word said twice in a row.
NUMBER, CAPITALS, AGAIN = (np.uint64(x) for x in (0x1B873593CC9E2D51, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


def runs(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the runs of letters (bytes beyond ASCII count as such), digits and other marks."""
    if not buf:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    kinds = _KIND[np.frombuffer(buf, np.uint8)]
    edges = np.flatnonzero(np.diff(kinds)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(buf)]))
    kind = kinds[starts]
    held = kind != _SPACE
    return starts[held], ends[held], kind[held]


def ngram_counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and length-normalised weights (square roots of counts) of a text's word uni- and bigrams; none if it has no words."""
    buf = encode(text)
    starts, ends, kind = runs(buf)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.float64)
    words = span_hashes(buf.lower(), starts, ends)
    words[kind == _DIGIT] = NUMBER
    upper = np.concatenate(([0], np.cumsum(_UPPER[np.frombuffer(buf, np.uint8)])))
    capitals = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    pairs[words[:-1] == words[1:]] = AGAIN
    every = np.concatenate((words, pairs, np.full(int(capitals.sum()), CAPITALS)))
    bucket, count = np.unique((every >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    weight = np.sqrt(count)
    return bucket, weight / np.sqrt((weight * weight).sum())


PREFIXES = (4, 5, 6, 7, 8)


def stem_set(text: str | None, bits: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text's words and of their first bytes; only those of nonzero weight where weights are given."""
    buf = encode(text).lower()
    starts, ends, kind = runs(buf)
    starts, ends = starts[kind == _LETTER], ends[kind == _LETTER]
    found = [span_hashes(buf, starts, ends)]
    for n in PREFIXES:
        longer = ends - starts > n
        found.append(mix(span_hashes(buf, starts[longer], starts[longer] + n) + np.uint64(n)))
    bucket = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
    return np.unique(bucket if weights is None else bucket[weights[bucket] != 0])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def remainder(id_column: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(id_column.cast("string")) % by


def labelled(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label 0 or 1): one row an id, 1 if any of its rows says so; null ids and labels are left out."""
    return (labels.select(F.col(id_col).cast("long").alias("id"), (F.col(column) == 1).cast("int").alias("label"))
            .filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))


def sample(ids: DataFrame, rows: int) -> DataFrame:
    """Up to `rows` rows of ids, those with the least of a hash of id; only ids and labels pass through the driver.

    Of a large table about twice as many are taken by the hash first, so that tasks send few rows, however
    many tasks there are.
    """
    total, order = ids.count(), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40))
    if total > 8 * rows:
        ids = ids.filter(order < int((1 << 40) * (2 * rows + 100) / total))
    drawn = ids.orderBy(order, "id").limit(rows).collect()
    return ids.sparkSession.createDataFrame(drawn, ids.schema)


def gather(docs: DataFrame, drawn: DataFrame, make: Callable[[str | None], tuple[np.ndarray, np.ndarray]],
           id_col: str, text_col: str) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(id, label, buckets, weights) of the drawn documents, made where their texts are. drawn is bounded, so it is broadcast.

    An id and label count once, however many rows share the id: with the smallest of their texts.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [make(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"],
                                "bucket": [b.astype("<i4").tobytes() for b, _ in made], "weight": [w.astype("<f4").tobytes() for _, w in made]})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    once = slim.join(F.broadcast(drawn.distinct()), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = once.mapInPandas(run, "id long, label int, bucket binary, weight binary").collect()
    return sorted(((r.id, r.label, np.frombuffer(r.bucket, "<i4"), np.frombuffer(r.weight, "<f4")) for r in rows), key=lambda r: (r[0], r[1], len(r[2])))


def score(docs: DataFrame, one: Callable[[str | None], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": [one(t) for t in batch["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, score double")
