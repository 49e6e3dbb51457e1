"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.features import gather, labelled, ngram_counts, remainder, sample, score, sigmoid

BITS = 18
#: At most so many labelled documents are fitted on.
SAMPLE_ROWS = 6000
THRESHOLD = 0.3


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal state: sums of gradients z and of their squares n give the weights in closed form."""

    bits: int = BITS
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def __post_init__(self):
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, step)

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(bucket, 1 << self.bits), np.append(value, 1.0)  # the last coordinate is the intercept
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: Iterable[tuple[int, np.ndarray, np.ndarray]], rounds: int = 4, seed: int = 3, bits: int = BITS) -> np.ndarray:
    """Weights, the intercept last, from (label, buckets, values). Without rows all are zero, so every score is one half."""
    rows, model, rng = list(rows), Ftrl(bits), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            label, bucket, value = rows[i]
            model.learn(bucket, value * SCALE, label)
    return model.weights()


#: Values have unit length; this brings them to the intercept's scale.
SCALE = 4.0


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """labels (id, column) are rows that may be learnt from; at most sample_rows of them are fitted on."""
    drawn = sample(labelled(labels, column, id_col), sample_rows)
    rows = gather(docs, drawn, lambda t: ngram_counts(t, BITS), id_col, text_col)
    return fit((label, bucket, value) for _, label, bucket, value in rows)


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score 0 to 1) for each row; a text without words gets the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def one(text):
        bucket, value = ngram_counts(text, BITS)
        w = shared.value
        return float(sigmoid(float(w[bucket] @ value.astype(np.float32)) * SCALE + float(w[-1])))

    return score(docs, one, id_col, text_col)


def op8_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    A row without an id is never held out, and never learnt from. Null and empty texts, and those without words,
    get the intercept's score; very long ones are read whole; equal texts have equal scores. Rows that share an id
    are scored each, and learnt from as one, with the smallest of their texts and label 1 if any of the id's labels
    is. Other columns are not looked at; an empty table gives an empty result.
    """
    weights = train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    return scored(docs, weights).select(F.col("id").alias("doc_id"), F.coalesce(remainder(F.col("id"), 5) == 0, F.lit(False)).alias("held_out"),
                                        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
