"""Vectors: exact cosine neighbours, exact and semantic merge, embedding drain."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length; an error where dimensions differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def knn(vectors: DataFrame, query: list[float], limit: int, model: str | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score) of the nearest vectors of the query's dimension, score descending, id ascending.

    One scan and a top-k in each task; the query is a literal. A limit of zero or less gives nothing.
    """
    rows = vectors if model is None else vectors.filter(F.col("model_id") == model)
    rows = rows.filter(F.size(vector_col) == len(query))
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(max(0, limit))


def merge_hits(exact: DataFrame, semantic: DataFrame, limit: int | None = None, min_score: float = 0.0) -> DataFrame:
    """(id, origin, score, pos): exact hits (id, pos) in their order, then semantic ones (id, score) by score and id.

    An id in both is exact. The best score of an id counts. The limit never drops exact hits.
    """
    best = semantic.groupBy("id").agg(F.max("score").alias("score"))
    both = exact.groupBy("id").agg(F.min("pos").alias("pos")).join(best, "id", "full_outer")
    kept = both.filter(F.col("pos").isNotNull() | (F.col("score") >= min_score)).select(
        "id", F.when(F.col("pos").isNull(), "semantic").when(F.col("score").isNull(), "exact").otherwise("both").alias("origin"), "score", "pos")
    if limit is None:
        return kept
    others = kept.filter("pos is null").orderBy(F.col("score").desc(), "id").limit(limit)
    room = F.broadcast(exact.agg(F.greatest(F.lit(limit) - F.countDistinct("id"), F.lit(0)).alias("room")))
    taken = others.withColumn("_n", F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))).crossJoin(room).filter("_n <= room").drop("_n", "room")
    return kept.filter("pos is not null").unionByName(taken)


def encode_vector(vector: list[float]) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def decode_vectors(column: Column) -> Column:
    """Little-endian float32 blobs as arrays."""
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else np.frombuffer(b, "<f4")), T.ArrayType(T.FloatType()))(column)


def passage_text(description: Column, search_meta: Column) -> Column:
    """What is embedded of an item: its texts, one a line; null if it has none."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (description, search_meta)]
    return F.nullif(F.concat_ws("\n", *parts), F.lit(""))


def input_line(text: Column, prefix: str = "passage: ") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(text, r"[\r\n]+", " "))


Embedder = Callable[[list[str]], np.ndarray]
#: How far from 1 the length of a unit vector may be.
UNIT_SLACK = 1e-3


def hashing_embedder(dim: int = 384) -> Embedder:
    """A deterministic embedder for tests and for want of a model: signed hashed words, of unit length."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)
    return embed


def aligned(made, count: int, dim: int, unit: bool = True) -> list[np.ndarray | None]:
    """An embedder's vectors for `count` texts: None for one that is of another length, not finite or, if asked for, not of unit length.

    Another number of vectors than of texts is an error of the whole batch, as none can be told to be whose.
    """
    made = list(made)
    if len(made) != count:
        raise ValueError("another number of vectors than of texts")
    out: list[np.ndarray | None] = []
    for v in made:
        v = np.asarray(v, np.float32)
        length = float(np.sqrt((v.astype(np.float64) ** 2).sum())) if v.ndim == 1 and len(v) == dim else float("nan")
        out.append(v if np.isfinite(length) and (not unit or abs(length - 1) <= UNIT_SLACK) else None)
    return out


def embed(items: DataFrame, embedder: Embedder, dim: int = 384, batch: int = 16, unit: bool = True) -> DataFrame:
    """(id, vector, embed_status) for each pending item: done, skipped without text, error where its batch or its own vector fails."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            vectors, status = [], []
            for i in range(0, len(frame), batch):
                texts = frame["text"].iloc[i:i + batch]
                full = [t for t in texts if t is not None and t == t]
                try:
                    made = aligned(embedder(full), len(full), dim, unit) if full else []
                except Exception:  # one bad batch is reported row by row; the others go on
                    made = [None] * len(full)
                rows = iter(made)
                for t in texts:
                    if t is None or t != t:
                        vectors.append(None)
                        status.append("skipped")
                    else:
                        vectors.append(v := next(rows))
                        status.append("error" if v is None else "done")
            yield pd.DataFrame({"id": frame["id"], "vector": vectors, "embed_status": status})

    texts = items.filter("embed_status = 'pending'").select("id", input_line(passage_text(F.col("description"), F.col("search_meta"))).alias("text"))
    return texts.mapInPandas(run, T.StructType([T.StructField("id", items.schema["id"].dataType), T.StructField("vector", T.ArrayType(T.FloatType())),
                                                T.StructField("embed_status", T.StringType())]))
