"""SimHash near-duplicate grouping with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import broadcast_up_to, cut, encode, fresh, partitions
from keepsake.llm.components import components

MAX_BITS = 4
#: (fingerprints up to which it serves, segments, segments of a key). Four differing bits leave three segments with one
#: of at most one bit, five with such a pair of them, six with such a triple: keys of 20, 24 and 31 bits besides the wildcard.
SCHEMES = ((1 << 22, 3, 1), (1 << 25, 5, 2), (None, 6, 3))
#: Signature buckets with more distinct fingerprints than this are linked through shared neighbours.
BUCKET_PAIRS = 512
#: Crowded signatures that may be broadcast (8 bytes each).
BROADCAST_ROWS = 500_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's lower-cased word shingles, as a signed number.

    Fewer than `width` words make one shingle; a text without words (null, empty) has fingerprint zero.
    """
    words = encode(text).lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    one = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    ones, n, more = np.zeros(64, np.int64), 0, True
    while more:  # blocks of shingles bound the memory of a very long text
        block = [one(line[s:e], 42) for (s, e), _ in zip(spans, range(65536), strict=False)]
        more = len(block) == 65536
        if block:
            bits = np.unpackbits(np.array(block, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(0, dtype=np.int64)
            n += len(block)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fp": np.array([fingerprint(t, width) for t in batch["text"]], dtype=np.int64)})
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) for each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(_fingerprints(width), "id long, fp long")


def masks(segments: int, together: int) -> list[int]:
    """The bits of each key: every choice of `together` segments out of all."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(parts, together)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def _signature(fp: Column, keep: Column) -> Column:
    return F.xxhash64(fp.bitwiseAND(keep), keep)


def _signatures(fp: Column, keys: list[int]) -> Column:
    """A signature for each bit of each key: the key without that bit, hashed with the bits that it keeps."""
    keeps = [mask & ~(1 << bit) for mask in keys for bit in range(64) if mask >> bit & 1]
    return F.transform(_longs(keeps), lambda keep: _signature(fp, keep))


def _first_shared(a: Column, differ: Column, keys: list[int]) -> Column:
    """The first signature that a and another fingerprint share, which differs from it by `differ`; each pair is taken there alone."""
    near = lambda mask: F.bit_count(differ.bitwiseAND(mask)) <= 1
    mask = F.get(F.filter(_longs(keys), near), F.lit(0))
    part = differ.bitwiseAND(mask)
    # The wildcard is the differing bit, or the key's lowest one if there is none.
    lowest = mask.bitwiseAND(F.bitwise_not(mask) + F.lit(1))
    return _signature(a, mask.bitwiseAND(F.bitwise_not(F.when(part == 0, lowest).otherwise(part))))


def _ball(fp: Column) -> Column:
    """All 2,081 values within two bits of a fingerprint."""
    bits = F.array(*[F.lit(0 if i < 0 else (1 << i if i < 63 else -(1 << 63))).cast("long") for i in range(-1, 64)])
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(65)), lambda i: F.transform(
        F.slice(bits, 1, i), lambda low: low.bitwiseXOR(F.when(i <= 64, F.element_at(bits, F.least(i + 1, F.lit(65)))).otherwise(F.lit(0))))))
    return F.transform(F.array_distinct(F.array_union(pairs, F.array(F.lit(0).cast("long")))), lambda m: m.bitwiseXOR(fp))


def links(prints: DataFrame, bucket_pairs: int = BUCKET_PAIRS, scheme: tuple[int, int] | None = None) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of "at most four bits differ".

    The number of fingerprints chooses how long the keys are (SCHEMES), so that buckets stay small; each pair is
    compared at one signature only, and every scheme finds every pair. Should a bucket have more than
    `bucket_pairs` fingerprints all the same, each of them is linked to each value within two bits of it instead:
    two of them differ by at most four bits exactly if they have such a value in common. That takes 2,081 rows a
    fingerprint however large the bucket is, and each edge (value, smallest fingerprint near it) is a link.
    """
    spark = prints.sparkSession
    n = prints.count() if scheme is None else 0
    keys = masks(*(scheme or next((s, k) for most, s, k in SCHEMES if most is None or n <= most)))
    # A row becomes many: few partitions of few rows would make large tasks. The rows come dealt by fp, and another
    # deal by fp would be left out, so they are dealt by its hash.
    signed = prints.repartition(partitions(spark), F.xxhash64("fp")).select("fp", F.explode(_signatures(F.col("fp"), keys)).alias("sig"))
    heavy = signed.groupBy("sig").count().filter(F.col("count") > bucket_pairs).select("sig")
    # As a rule no bucket is heavy; this is a look at one row, and spares the light path a join.
    if heavy.limit(1).count():
        heavy = broadcast_up_to(cut(heavy), BROADCAST_ROWS)
        crowded = signed.join(heavy, "sig", "left_semi").select("fp").distinct()
        near = cut(crowded.select("fp", F.explode(_ball(F.col("fp"))).alias("near")))
        least = near.groupBy("near").agg(F.min("fp").alias("first"))
        extra = near.hint("merge").join(least, "near").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
        signed = signed.join(heavy, "sig", "left_anti")
    else:
        extra = None
    # Spark takes exploded rows for as few as they come from and would broadcast the signatures of some 0.6 GB of texts; they are joined by shuffle.
    left, right = signed.select("sig", F.col("fp").alias("a")), signed.select("sig", F.col("fp").alias("b")).hint("merge")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    close = (left.join(right, "sig").filter("a < b").filter(F.bit_count(differ) <= MAX_BITS)
             .filter(_first_shared(F.col("a"), differ, keys) == F.col("sig")).select("a", "b"))
    return close if extra is None else close.union(extra)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                    bucket_pairs: int = BUCKET_PAIRS, scheme: tuple[int, int] | None = None) -> DataFrame:
    """(id, fp, component) for each row: component is the smallest id that the row reaches by links.

    Rows of equal fingerprint are one node, so repeated rows and large groups of copies cost one row each.
    Null, empty and white-space texts share fingerprint zero and are linked like any other. A row without
    an id is kept; it takes its component's smallest id, or null if no row there has one. Very long texts are
    read in blocks of shingles. An empty table gives an empty result; other columns are not looked at.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(nodes.select("fp"), bucket_pairs, scheme))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    labels = named.join(least, "root").select("fp", "component")
    return prints.join(labels, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """The rows of docs whose id is the smallest of its group, one row an id; rows without an id stay."""
    key = fresh(docs, "_keep")
    firsts = near_duplicates(docs, id_col, text_col, width).filter("component is not null").select(F.col("component").alias(key)).distinct()
    kept = docs.join(firsts, F.col(id_col).cast("long") == F.col(key), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def op1_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id: a row for each row of docs.

    Nulls, empty and very long texts, repeated rows, clashing columns and empty tables are as in near_duplicates().
    """
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
