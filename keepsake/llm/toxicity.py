"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.features import gather, labelled, remainder, sample, score, sigmoid, stem_set

BITS = 20
#: At most so many confirmed toxic and so many unlabelled documents are fitted on.
POSITIVE_ROWS, UNLABELLED_ROWS = 2000, 4000
THRESHOLD = 0.3
STEPS, RATE, DECAY = 400, 0.05, 1e-3


def chosen(positive: list[np.ndarray], unlabelled: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Buckets that positives have more often than unlabelled texts, beyond chance."""
    size = 1 << bits
    p = np.bincount(np.concatenate(positive), minlength=size)
    u = np.bincount(np.concatenate(unlabelled), minlength=size) if unlabelled else np.zeros(size)
    n_p, n_u = len(positive), max(1, len(unlabelled))
    pooled = (p + u + 1) / (n_p + n_u + 2)
    z = (p / n_p - u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    return np.flatnonzero((p >= 4) & (z > 5.0))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS) -> np.ndarray:
    """Weights, the intercept last, from each text's set of buckets.

    The risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with logistic loss l: the second
    part estimates the risk on clean texts from unlabelled ones. Where it falls below zero, which only
    fitting noise can do, the step goes up that part instead, as non-negative learning prescribes.
    """
    weights = np.zeros((1 << bits) + 1)
    weights[-1] = -60.0
    if not positive or prior <= 0:
        return weights
    picked = chosen(positive, unlabelled, bits)
    place = np.full(1 << bits, -1)
    place[picked] = np.arange(len(picked))
    sets = [place[b][place[b] >= 0] for b in [*positive, *unlabelled]]
    row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
    n_p, n_u = len(positive), len(unlabelled)
    w, b = np.zeros(len(picked)), np.log(prior / max(1 - prior, 1e-9))
    m, v = np.zeros(len(picked) + 1), np.zeros(len(picked) + 1)
    for step in range(1, STEPS + 1):
        f = np.bincount(row, w[col], minlength=len(sets)) + b
        q = sigmoid(f)
        clean = (np.logaddexp(0, f[n_p:]).mean() if n_u else 0.0) - prior * np.logaddexp(0, f[:n_p]).mean()
        g_f = np.empty(len(sets))
        if clean >= 0:
            g_f[:n_p] = prior / n_p * (q[:n_p] - 1) - prior / n_p * q[:n_p]
            g_f[n_p:] = q[n_p:] / max(1, n_u)
        else:
            g_f[:n_p] = prior / n_p * q[:n_p]
            g_f[n_p:] = -q[n_p:] / max(1, n_u)
        g = np.append(np.bincount(col, g_f[row], minlength=len(picked)) + DECAY * w, g_f.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    # A text without any of the words cannot be likelier toxic than texts are on average; with few positives
    # the fitted intercept may say so.
    weights[picked], weights[-1] = w, min(b, np.log(prior / (1 - prior)))
    return weights


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> np.ndarray:
    """labels are rows that may be learnt from: their positives are fitted on, their share of positives is the prior.

    Unlabelled texts are drawn from all documents without a look at labels. Without a positive label every score is 0.
    """
    known = labelled(labels, column, id_col)
    prior = known.agg(F.avg("label")).first()[0] or 0.0
    drawn = sample(known.filter("label = 1"), positive_rows)
    others = sample(docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("label")).filter("id is not null"), unlabelled_rows)
    make = lambda t: ((s := stem_set(t, BITS)), s[:0])
    rows = gather(docs, drawn.union(others), make, id_col, text_col)
    return fit([b for _, label, b, _ in rows if label], [b for _, label, b, _ in rows if not label], min(float(prior), 0.5))


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score 0 to 1) for each row; a text without words gets the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def one(text):
        w = shared.value
        return float(sigmoid(float(w[stem_set(text, BITS, w)].sum()) + float(w[-1])))

    return score(docs, one, id_col, text_col)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, columns unchanged; the score is made beside each row, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col).astype(np.float32))

    # Texts become strings one at a time, not by the batch.
    def keep(texts: pa.Array) -> pa.Array:
        w = shared.value
        return pa.array([bool(sigmoid(float(w[stem_set(t.as_py(), BITS, w)].sum()) + float(w[-1])) < threshold) for t in texts], pa.bool_())

    return docs.filter(F.arrow_udf(keep, "boolean")(F.col(text_col)))


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    A row without an id is never held out, and never learnt from. Null and empty texts, and those without words,
    get the intercept's score; very long ones are read whole; equal texts have equal scores. Rows that share an id
    are scored each, and learnt from as one, with the smallest of their texts and label 1 if any of the id's labels
    is. Other columns are not looked at; an empty table gives an empty result.

    The class prior is the share of positives among the labels that may be learnt from, at most 0.5, and the
    intercept is held at or below the prior's; without a positive label every score is 0.
    """
    weights = train(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))
    return scored(docs, weights).select(F.col("id").alias("doc_id"), F.coalesce(remainder(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"),
                                        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
