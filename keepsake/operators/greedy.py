"""Greedy clustering of vectors by moving centroids, exactly as item by item, over tables of any size.

A vector joins the cluster whose centroid is most similar (the first founded of equals) if that reaches the threshold,
and else founds one; the centroid of the cluster moves before the next vector comes. Blocks of vectors are speculated
on: all centroids are compared with a block at once, in parallel, as they stand before it. Then the block is replayed
in order. A centroid that nothing of the block has joined yet has not moved, so what was found for it still holds;
those that have moved are in hand and are compared anew. A vector whose findings are all about moved centroids, while
there may be others, ends the block early, and the next block begins with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators.graph import cut, shared_folder

#: Vectors of a block, and the centroids that are found for each of them.
BLOCK, FOUND = 4_000, 16
#: Bytes of centroids up to which all of them are in hand, so that nothing need be found beforehand, and blocks that are then read at once.
IN_HAND, AHEAD = 4 << 20, 8
#: Dimensions after which a bound tells whether a pair can still reach the threshold.
PREFIX = 64
#: Similarities closer than this are compared again, one pair at a time.
CLOSE = 1e-9


def check(ids: list, vectors: np.ndarray, threshold: float, min_size: int) -> None:
    if len(vectors) and (vectors.ndim != 2 or not vectors.shape[1] or not np.isfinite(vectors).all()):
        raise ValueError("vectors must be finite, not empty and of one dimension")
    if len(set(ids)) != len(ids):
        raise ValueError("ids repeat")
    _check_options(threshold, min_size)


def _check_options(threshold: float, min_size: int) -> None:
    if not -1 <= threshold <= 1 or min_size < 1:
        raise ValueError("bad options")


def centre_of(total: np.ndarray, count: int) -> np.ndarray:
    """A cluster's centroid: a mean in double precision, kept in single precision."""
    return (total / count).astype(np.float32).astype(np.float64)


def cosine(x: np.ndarray, c: np.ndarray) -> float:
    """One pair's similarity, 0 where one has no length; how ties and the threshold are decided."""
    size = np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(c, c))
    return float(np.dot(x, c) / size) if size > 0 else 0.0


@dataclass
class InHand:
    """Clusters that can be compared: number, sum, count, centroid and its length, in rows that grow."""

    width: int
    number: list[int] = field(default_factory=list)
    at: dict[int, int] = field(default_factory=dict)
    counts: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.sums, self.centres, self.lengths = np.zeros((64, self.width)), np.zeros((64, self.width)), np.zeros(64)

    def add(self, number: int, total: np.ndarray, count: int) -> None:
        k = len(self.number)
        if k == len(self.centres):
            self.sums, self.centres = (np.vstack((a, np.zeros_like(a))) for a in (self.sums, self.centres))
            self.lengths = np.append(self.lengths, np.zeros_like(self.lengths))
        self.at[number] = k
        self.number.append(number)
        self.counts.append(0)
        self._put(k, total, count)

    def join(self, number: int, x: np.ndarray) -> None:
        k = self.at[number]
        self._put(k, self.sums[k] + x, self.counts[k] + 1)

    def _put(self, k: int, total: np.ndarray, count: int) -> None:
        self.sums[k], self.counts[k] = total, count
        self.centres[k] = centre_of(total, count)
        self.lengths[k] = np.sqrt((self.centres[k] ** 2).sum())

    def similar(self, x: np.ndarray, norm: float) -> np.ndarray:
        k = len(self.number)
        size = self.lengths[:k] * norm
        return np.where(size > 0, self.centres[:k] @ x / np.where(size > 0, size, 1), 0.0)


def replay(vectors: np.ndarray, hand: InHand, founded: int, threshold: float, found: list[list[tuple[float, int]]] | None = None, more: np.ndarray | None = None,
           resting: dict[int, tuple[np.ndarray, int]] | None = None) -> list[int]:
    """The cluster number of each vector, in order; fewer than there are vectors where findings ran out.

    hand holds the clusters that may have moved. found are, for each vector, (similarity, number) of others from the
    most similar down, as they rest in `resting`; more tells whether there are further ones. A new
    cluster gets the number `founded` and those after it.
    """
    out: list[int] = []
    x = vectors.astype(np.float32).astype(np.float64)
    norms = np.sqrt((x * x).sum(1))
    for i in range(len(x)):
        options: list[tuple[float, int]] = []
        if found:
            still = [(s, n) for s, n in found[i] if n not in hand.at]
            if not still and more[i]:
                break
            options += [(s, n) for s, n in still if s >= still[0][0] - CLOSE]
        if hand.number:
            sims = hand.similar(x[i], norms[i])
            top = sims.max()
            options += [(float(sims[k]), hand.number[k]) for k in np.flatnonzero(sims >= top - CLOSE)]
        best = max((s for s, _ in options), default=-2.0)
        number = -1
        if best >= threshold - CLOSE:
            near = [n for s, n in options if s >= best - CLOSE]
            exact = [(-cosine(x[i], hand.centres[hand.at[n]] if n in hand.at else centre_of(*resting[n])), n) for n in near]
            least, number = min(exact)
            number = number if -least >= threshold else -1
        if number < 0:
            number, founded = founded, founded + 1
            hand.add(number, x[i].copy(), 1)
        else:
            if number not in hand.at:
                hand.add(number, *resting[number])
            hand.join(number, x[i])
        out.append(number)
    return out


def greedy_clusters(ids: list, vectors: np.ndarray, threshold: float, min_size: int) -> list[tuple[int, float]]:
    """(cluster, similarity to its last centroid) of each vector in the given order; cluster -1 for those in too small ones."""
    check(ids, vectors, threshold, min_size)
    if not len(vectors):
        return []
    hand = InHand(vectors.shape[1])
    of = replay(vectors, hand, 0, threshold)
    held = np.array(hand.counts) >= min_size
    number = np.where(held, np.cumsum(held) - 1, -1)
    x = vectors.astype(np.float32).astype(np.float64)
    return [(int(number[c]), cosine(x[i], hand.centres[c])) for i, c in enumerate(of)]


def _reaching(block: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, centroid, similarity) of the pairs that reach the threshold, but for rounding.

    After PREFIX dimensions what is left of a product is at most the product of what is left of the lengths;
    where that rules most pairs out, only the others are finished.
    """
    a, b = np.sqrt((block * block).sum(1)), np.sqrt((centres * centres).sum(1))
    size = a[:, None] * b[None, :]
    need = (threshold - CLOSE) * size
    dots = block[:, :PREFIX] @ centres[:, :PREFIX].T
    if block.shape[1] > PREFIX:
        rest = np.sqrt((block[:, PREFIX:] ** 2).sum(1))[:, None] * np.sqrt((centres[:, PREFIX:] ** 2).sum(1))[None, :]
        i, j = np.nonzero(dots + rest * (1 + 1e-9) >= need)
        if 8 * len(i) < dots.size:
            dots = dots[i, j] + (block[i, PREFIX:] * centres[j, PREFIX:]).sum(1)
        else:
            dots = (block @ centres.T)[i, j]
    else:
        i, j = np.nonzero(dots >= need)
        dots = dots[i, j]
    size = size[i, j]
    sims = np.where(size > 0, dots / np.where(size > 0, size, 1), 0.0)
    keep = sims >= threshold - CLOSE
    return i[keep], j[keep], sims[keep]


def _finder(sent, threshold: float, most: int):
    """For centroids (number, total, count): each block vector's `most` most similar ones, and one more where there are more."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = sent.value.astype(np.float64)
        for batch in batches:
            numbers = batch["number"].to_numpy(np.int64)
            centres = np.stack([centre_of(np.asarray(t), c) for t, c in zip(batch["total"], batch["count"], strict=True)]) if len(batch) else np.empty((0, block.shape[1]))
            i, j, sims = _reaching(block, centres, threshold)
            order = np.lexsort((numbers[j], -sims, i))
            i, j, sims = i[order], j[order], sims[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place <= most
            yield pd.DataFrame({"i": i[keep], "similarity": sims[keep], "number": numbers[j[keep]]})
    return run


_STATE = "number long, total array<double>, count long"


class Clusters:
    """The clusters so far: in hand from block to block while they are small, then as files of which the next block's state is written from the last."""

    def __init__(self, spark, folder: str, width: int):
        self.spark, self.folder, self.width, self.turn, self.founded = spark, folder, width, 0, 0
        self.hand: InHand | None = InHand(width)

    def table(self) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(f"{self.folder}/state-{self.turn}")

    def assign(self, block: np.ndarray, threshold: float, found: int, in_hand: int) -> list[int]:
        """The numbers of a block's first vectors, one at least; unless all clusters are in hand, those that they joined are written anew."""
        if self.hand is not None:
            of = replay(block, self.hand, self.founded, threshold)
            self.founded = len(self.hand.number)
            if self.founded * self.width * 8 > in_hand:
                self.put_down()
            return of
        hand, lists, more = InHand(self.width), [[] for _ in range(len(block))], np.zeros(len(block), bool)
        sent = self.spark.sparkContext.broadcast(block.astype(np.float32))
        near = self.table().mapInPandas(_finder(sent, threshold, found), "i int, similarity double, number long")
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "number"))
        top = cut(near.withColumn("rank", rank).filter(F.col("rank") <= found + 1))
        for r in top.orderBy("i", "rank").collect():
            if r["rank"] > found:
                more[r["i"]] = True
            else:
                lists[r["i"]].append((r["similarity"], r["number"]))
        wanted = self.table().join(top.select("number").distinct(), "number", "left_semi")
        resting = {r["number"]: (np.array(r["total"]), r["count"]) for r in wanted.collect()}
        sent.destroy()
        of = replay(block, hand, self.founded, threshold, lists, more, resting)
        self.founded = max([self.founded, *(n + 1 for n in of)])
        touched = sorted(set(of))
        # A block joins a bounded number of clusters.
        gone = F.broadcast(self.spark.createDataFrame([(n,) for n in touched], "number long"))
        self._write(self.table().join(gone, "number", "left_anti").unionByName(self._rows(hand, touched)))
        return of

    def put_down(self) -> None:
        """Writes the clusters that are in hand; from then on they are files."""
        if self.hand is not None:
            self._write(self._rows(self.hand, self.hand.number))
            self.hand = None

    def _rows(self, hand: InHand, numbers: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(n, hand.sums[hand.at[n]].tolist(), hand.counts[hand.at[n]]) for n in numbers], _STATE)

    def _write(self, state: DataFrame) -> None:
        state.write.parquet(f"{self.folder}/state-{self.turn + 1}")
        self.turn += 1


def clusters_in_blocks(vectors: DataFrame, threshold: float, min_size: int, block: int = BLOCK, found: int = FOUND, in_hand: int = IN_HAND) -> DataFrame:
    """(id, cluster, similarity) of vectors (id, vector) in the order of their ids; items in too small clusters have no row.

    The result is that of greedy_clusters over the whole table, whatever the size of a block. A block of vectors
    at a time is in the driver's hand, with the centroids found for it; members are files, and so are centroids of more than
    in_hand bytes. Up to those, AHEAD blocks are read in a round that needs nothing else; beyond, a round is of one block and
    reads all centroids once. Rounds grow with the number of vectors, as every vector may move a centroid for those after it. Clusters are numbered by their founding, small ones left out. Rows without an id
    or a vector have no row; ids that repeat and vectors that are empty, not finite or of several lengths are errors.
    """
    _check_options(threshold, min_size)
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}"
    kind = vectors.schema["id"].dataType.simpleString()
    whole = F.transform("vector", lambda v: v.cast("float"))
    slim = vectors.filter("id is not null and vector is not null").select("id", whole.alias("vector"))
    numbered = cut(slim.repartitionByRange("id").sortWithinPartitions("id").withColumn("mark", F.monotonically_increasing_id()))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    seen = numbered.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.min(sound.cast("int")).alias("sound")).first()
    if not seen["n"]:
        return spark.createDataFrame([], f"id {kind}, cluster int, similarity double")
    if seen["low"] != seen["high"] or not seen["low"] or not seen["sound"]:
        raise ValueError("vectors must be finite, not empty and of one dimension")
    if numbered.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("ids repeat")
    # The place of a row: where its partition starts, and its place there.
    parts = sorted(numbered.groupBy(F.shiftright("mark", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    starts = spark.createDataFrame([(p["part"], sum(q["n"] for q in parts[:k])) for k, p in enumerate(parts)], "part long, start long")
    numbered.withColumn("part", F.shiftright("mark", 33)).join(F.broadcast(starts), "part").select("id", "vector", (F.col("start") + F.col("mark").bitwiseAND((1 << 33) - 1)).alias("place")).write.parquet(f"{folder}/rows")
    rows, state, at, rounds = spark.read.parquet(f"{folder}/rows"), Clusters(spark, folder, seen["low"]), 0, 0
    while at < seen["n"]:
        # Files and row groups are in the order of places, so this reads those of the blocks.
        most = block if state.hand is None else block * AHEAD
        part = rows.filter((F.col("place") >= at) & (F.col("place") < at + most)).select("place", "vector").toArrow()
        x = part["vector"].combine_chunks().flatten().to_numpy().reshape(len(part), -1)[np.argsort(part["place"].to_numpy())]
        of = state.assign(x[:block], threshold, found, in_hand)
        while state.hand is not None and len(of) < len(x):
            of += state.assign(x[len(of):len(of) + block], threshold, found, in_hand)
        rounds += 1
        spark.createDataFrame(pa.table({"place": np.arange(at, at + len(of)), "number": np.array(of, np.int64)})).write.parquet(f"{folder}/members/{rounds}")
        at += len(of)
    state.put_down()
    members = spark.read.schema("place long, number long").parquet(*[f"{folder}/members/{i + 1}" for i in range(rounds)])
    kept = state.table().filter(F.col("count") >= min_size)
    # One row a cluster is numbered.
    clusters = kept.select("number", "total", "count", (F.row_number().over(Window.orderBy("number")) - 1).alias("cluster"))

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sims = [cosine(np.asarray(v, np.float64), centre_of(np.asarray(t), c)) for v, t, c in zip(b["vector"], b["total"], b["count"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "cluster": b["cluster"], "similarity": np.array(sims, float)})

    return rows.join(members, "place").join(clusters, "number").select("id", "vector", "total", "count", "cluster").mapInPandas(similar, f"id {kind}, cluster int, similarity double")
