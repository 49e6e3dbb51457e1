"""Hard negatives: rows of another label whose score with an anchor lies just under that of its positives.

The anchors of a round are spanned by a tree of least total edge length. A row's score with an anchor is its score
with the anchor's parent, plus or minus the length of the edge times the row's norm; so the interval of a row goes
down the tree, and only rows whose interval meets a window that the anchor still has open are scored again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import cut, partitions, shared_folder

#: Anchors of a round, and the bytes of their vectors that a task may hold.
ANCHORS, ANCHOR_BYTES = 4096, 32 << 20
#: Rows scored at a time.
BLOCK = 4096
#: Components are held within this, so that scores fit 64 bits at up to 1,024 dimensions.
COMPONENT = 1 << 26
#: Other rows of an anchor's label that are its positives, negatives for each, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
_LEAST = -(1 << 62)


@dataclass
class Tree:
    """Anchors in an order in which parents come first."""

    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    last: np.ndarray  # the place of the last child, -1 where there is none


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The places of the vectors in the tree's order, and the tree of least total length over them.

    Of a vector's children the one with most below it comes last: a walk then holds intervals of few vectors at a time.
    """
    n, v = len(vectors), vectors.astype(np.float64)
    square = (v * v).sum(1)
    near, link, free = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    joined, at = [0], 0
    free[0] = False
    for _ in range(n - 1):
        away = np.maximum(square + square[at] - 2 * (v @ v[at]), 0)
        closer = free & (away < near)
        near[closer], link[closer] = away[closer], at
        at = int(np.argmin(np.where(free, near, np.inf)))
        free[at] = False
        joined.append(at)
    below = np.ones(n, np.int64)
    for at in reversed(joined[1:]):
        below[link[at]] += below[at]
    children: list[list[int]] = [[] for _ in range(n)]
    for at in sorted(joined[1:], key=lambda x: below[x]):
        children[link[at]].append(at)
    order, stack = [], [0]
    while stack:
        order.append(at := stack.pop())
        stack += reversed(children[at])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    parent = np.array([-1 if link[at] < 0 else place[link[at]] for at in order])
    # The edge is measured by differences, and rounded up: a bound must hold.
    edge = np.array([0.0 if p < 0 else float(np.sqrt(((v[order[i]] - v[order[p]]) ** 2).sum())) * (1 + 1e-9) for i, p in enumerate(parent)])
    last = np.array([place[children[at][-1]] if children[at] else -1 for at in order])
    return np.array(order), Tree(vectors[order], parent, edge, last)


class Scorer:
    """Exact whole-number scores of rows: through floating point where that is exact, else through 64-bit integers."""

    def __init__(self, rows: np.ndarray, tree: Tree):
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(tree.vectors).max(initial=0)) * max(1, rows.shape[1])
        kind = np.float64 if most < 1 << 53 else np.int64
        self.rows, self.anchors = rows.astype(kind), tree.vectors.astype(kind)

    def __call__(self, anchor: int, which: np.ndarray | slice) -> np.ndarray:
        return (self.rows[which] @ self.anchors[anchor]).astype(np.int64)


def walk(tree: Tree, rows: np.ndarray, wanted: Callable, take: Callable) -> int:
    """Shows each anchor its open rows: wanted(anchor, low, high) picks them by their bounds, take(anchor, rows, scores) gets their exact scores.

    Returns how many scores were computed.
    """
    score, norm, held, done = Scorer(rows, tree), np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9), {}, 0
    for at, parent in enumerate(tree.parent.tolist()):
        if parent < 0:
            exact = score(at, slice(None)).astype(np.float64)
            low, high = exact - np.abs(exact) * 1e-15, exact + np.abs(exact) * 1e-15
            done += len(rows)
        else:
            slack = tree.edge[at] * norm
            low, high = held[parent][0] - slack, held[parent][1] + slack
            if tree.last[parent] == at:
                del held[parent]
        open_rows = wanted(at, low, high)
        if len(open_rows):
            scores = score(at, open_rows)
            done += len(open_rows)
            low[open_rows], high[open_rows] = scores - np.abs(scores) * 1e-15, scores + np.abs(scores) * 1e-15
            take(at, open_rows, scores)
        if tree.last[at] >= 0:
            held[at] = (low, high)
    return done


class Best:
    """The first few rows by score, largest first, then by id and row; kept as more rows come."""

    def __init__(self, most: int):
        self.most, self.score, self.id, self.row = most, *(np.empty(0, np.int64) for _ in range(3))

    def least(self) -> int:
        """A score that a further row must have at least."""
        return int(self.score[-1]) if len(self.score) == self.most else _LEAST

    def add(self, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        score, ids, row = np.concatenate((self.score, score)), np.concatenate((self.id, ids)), np.concatenate((self.row, row))
        first = np.lexsort((row, ids, -score))[: self.most]
        self.score, self.id, self.row = score[first], ids[first], row[first]


def _padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            some = batch.iloc[at:at + BLOCK]
            yield _padded(list(some["vector"]), width), some["row"].to_numpy(np.int64), some["id"].to_numpy(np.int64), some["label"].to_numpy(np.int64)


_FOUND = "anchor int, target long, score long, id long, row long"


def _emit(found: dict) -> pd.DataFrame:
    """Rows of _FOUND from {(anchor, target): Best}."""
    keep = [(k, b) for k, b in found.items() if len(b.score)]
    times = [len(b.score) for _, b in keep]
    column = lambda values: np.concatenate(values) if values else np.empty(0, np.int64)
    return pd.DataFrame({"anchor": np.repeat(np.array([k[0] for k, _ in keep], np.int32), times), "target": np.repeat(np.array([k[1] for k, _ in keep], np.int64), times),
                         "score": column([b.score for _, b in keep]), "id": column([b.id for _, b in keep]), "row": column([b.row for _, b in keep])})


def _nearest_alike(sent, most: int):
    """Each anchor's best other rows of its label, of one partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, rows, labels = sent.value
        found = {(a, 0): Best(most) for a in range(len(rows))}
        for vectors, row, ids, label in _blocks(batches, tree.vectors.shape[1]):
            def wanted(a, low, high, row=row, label=label):
                return np.flatnonzero((label == labels[a]) & (high >= found[a, 0].least()) & (row != rows[a]))

            def take(a, which, scores, ids=ids, row=row):
                found[a, 0].add(scores, ids[which], row[which])

            walk(tree, vectors, wanted, take)
        yield _emit(found)
    return run


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive, as first and last; none if first > last."""
    return -(-low * positive // 100), high * positive // 100


def _in_windows(sent, targets_sent, most: int, low_part: int, high_part: int):
    """Each anchor's best rows of other labels in the window of each of its positives' scores, of one partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, _, labels = sent.value
        targets = targets_sent.value  # anchor: distinct scores of its positives
        windows = {a: [(t, *window(t, low_part, high_part)) for t in ts] for a, ts in targets.items()}
        windows = {a: [w for w in ws if w[1] <= w[2]] for a, ws in windows.items()}
        found = {(a, t): Best(most) for a, ws in windows.items() for t, _, _ in ws}
        for vectors, row, ids, label in _blocks(batches, tree.vectors.shape[1]):
            def wanted(a, low, high, label=label):
                open_rows = np.zeros(len(low), bool)
                for t, first, last in windows.get(a, ()):
                    open_rows |= (high >= max(first, found[a, t].least())) & (low <= last)
                return np.flatnonzero(open_rows & (label != labels[a]))

            def take(a, which, scores, ids=ids, row=row):
                for t, first, last in windows[a]:
                    own = (scores >= max(first, found[a, t].least())) & (scores <= last)
                    if own.any():
                        found[a, t].add(scores[own], ids[which[own]], row[which[own]])

            walk(tree, vectors, wanted, take)
        yield _emit(found)
    return run


def _top(found: DataFrame, most: int) -> DataFrame:
    """found with its rank within (anchor, target), up to most; each partition sent so many rows at most."""
    rank = F.row_number().over(Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, vector array<long>): the rows that take part, components as floor(256 * x).

    Rows without an id, a label or a vector, and those with a null or non-finite component, take no part.
    Components beyond COMPONENT are held at it. row tells equal rows apart.
    """
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(256 * c.cast("double")), F.lit(-COMPONENT)), F.lit(COMPONENT)).cast("long"))
    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    taking = slim.filter("id is not null and label is not null and x is not null")
    sound_rows = taking.select("id", "label", "x").withColumnRenamed("x", vector_col).filter(sound).select("id", "label", whole.alias("vector"))
    even = sound_rows.repartition(partitions(rows.sparkSession))
    return cut(even.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector"))


def hard_negatives(rows: DataFrame, anchors: Column, folder: str | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, per_round: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over whole_vectors() rows; anchors tells which of them are anchors.

    Anchors are taken in rounds of a bounded number of bytes, by their row. In each, one pass over all rows
    finds the anchors' positives, and a second the rows of other labels in their windows; a task carries
    the best rows so far, which close windows as it goes on, and sends at most `positives` (`negatives`) rows
    an anchor (and positive). Nothing but a round's anchors and their positives' scores passes through the driver.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    per_round = max(1, min(per_round, ANCHOR_BYTES // (8 * max(1, width))))
    chosen, after, number = rows.filter(anchors), -1, 0
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    while drawn := chosen.filter(F.col("row") > after).orderBy("row").limit(per_round).collect():
        after = drawn[-1]["row"]
        order, tree = spanning_tree(_padded([np.array(r["vector"], np.int64) for r in drawn], width))
        drawn = [drawn[i] for i in order]
        sent = spark.sparkContext.broadcast((tree, np.array([r["row"] for r in drawn]), np.array([r["label"] for r in drawn])))
        best = _top(rows.mapInPandas(_nearest_alike(sent, positives), _FOUND), positives).select("anchor", "score", "id").collect()
        targets: dict[int, set[int]] = {}
        for r in best:
            targets.setdefault(r["anchor"], set()).add(r["score"])
        goals = spark.sparkContext.broadcast(targets)
        found = _top(rows.mapInPandas(_in_windows(sent, goals, negatives, low, high), _FOUND), negatives)
        wanted = spark.createDataFrame([(r["anchor"], drawn[r["anchor"]]["id"], r["id"], r["score"]) for r in best], "anchor int, anchor_id long, positive_id long, target long")
        joined = found.join(F.broadcast(wanted), ["anchor", "target"])  # at most per_round * positives rows
        joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("target").alias("positive_score"),
                      F.col("score").alias("negative_score")).write.parquet(f"{folder}/{number}")
        sent.destroy()
        goals.destroy()
        number += 1
    return spark.read.schema(schema).parquet(*[f"{folder}/{i}" for i in range(number)]) if number else spark.createDataFrame([], schema)


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 50.

    Where vec_id is divisible by 7 the label first becomes (label + 1) % 10. Rows without a label, vector or
    finite components take no part, nor do rows without an id, as they cannot be named. Vectors of different
    lengths are filled up with zeros; equal scores go by vec_id; each of several equal rows takes part for
    itself, also beside an anchor that it equals. An empty table gives an empty result.
    """
    rows = whole_vectors(embeddings).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 50 == 0)


#: The same in SQL.
ORACLE = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = v.label AS alike, v.r, v.vec_id, list_dot_product(a.e, v.e)::BIGINT AS score
        FROM v a, v WHERE a.vec_id % 50 = 0 AND a.r <> v.r),
      p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS k FROM s WHERE alike QUALIFY k <= 5),
      n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id, s.r) AS rank
        FROM p JOIN s ON s.ar = p.ar AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
      SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
