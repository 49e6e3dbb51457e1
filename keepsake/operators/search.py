"""Full-text search: postings, prefix phrases, BM25, snapshots."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.text import WRITTEN, query_terms, spellings, tokens
from keepsake.operators.graph import cut, spread
from keepsake.operators.timeline import order
from keepsake.schemas import SNAPSHOT_IDS

K1, B = 1.2, 0.75
#: What an inverse document frequency of zero or less counts as.
LEAST_IDF = 1e-6
#: Tokens of different columns are this far apart, so that no phrase crosses columns.
COLUMN_GAP = 1 << 20
#: Items whose tokens are put in order at once.
BATCH = 256


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, places, n) of rows (id, one list of tokens a column) in the order of their ids; rows of one id are one item."""
    def grouped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = [rows[c].combine_chunks() for c in rows.column_names[1:]]
        sizes = [np.diff(x.offsets.to_numpy()) for x in lists]
        row = np.concatenate([np.repeat(np.arange(len(k)), k) for k in sizes])
        place = np.concatenate([np.arange(k.sum()) - np.repeat(k.cumsum() - k, k) + i * COLUMN_GAP for i, k in enumerate(sizes)])
        words = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
        ids, code = rows["id"].combine_chunks(), words.indices.to_numpy()
        item = _numbered(ids)[row]
        order = np.lexsort((place, code, item))
        item, code, row, place = item[order], code[order], row[order], place[order]
        first = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (code[1:] != code[:-1])]) if len(item) else np.empty(0, np.int64)
        ends = np.r_[first, len(item)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), ids.take(pa.array(row[first])), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32))), pa.array(np.diff(ends).astype(np.int64))],
                                         names=["token", "id", "places", "n"])

    held = None
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            some = pa.Table.from_batches([batch.slice(at, BATCH)])
            held = some if held is None else pa.concat_tables([held, some])
            number = _numbered(held["id"].combine_chunks())
            # The last item may go on.
            whole = int(np.searchsorted(number, number[-1]))
            if whole:
                yield from grouped(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None:
        yield from grouped(held)


def _numbered(ids: pa.Array) -> np.ndarray:
    """0 for the first of ids in order, and one more for each other id."""
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.r_[0, np.cumsum(code[1:] != code[:-1])]


def postings(items: DataFrame, columns: tuple[str, ...] = ("title", "description", "search_meta")) -> DataFrame:
    """(token, id, places, n): where each token stands in each item. Written sorted by token, a prefix reads a few row groups.

    Texts are dealt by their items, so that they are shuffled once and their tokens are not.
    """
    kind = items.schema["id"].dataType.simpleString()
    dealt = items.select("id", *columns).repartition("id").sortWithinPartitions("id")
    cut_up = dealt.select("id", *[tokens(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    return cut_up.mapInArrow(_places, f"token string, id {kind}, places array<int>, n long")


def refreshed(index: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The index after some items (changed) were written and some ids (deleted) taken out."""
    gone = changed.select("id") if deleted is None else changed.select("id").unionByName(deleted.select("id"))
    return index.join(gone.distinct(), "id", "left_anti").unionByName(postings(changed))


def lengths(items: DataFrame, columns: tuple[str, ...] = ("title", "description", "search_meta")) -> DataFrame:
    """(id, length): tokens of each item over all columns."""
    return spread(items.select("id", *columns)).select("id", sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0)).cast("long").alias("length"))


def phrase_hits(index: DataFrame, phrase: list[str]) -> DataFrame:
    """(id, f): how often each item has the phrase, whose last token is a prefix."""
    last = index.filter(F.col("token").startswith(phrase[-1]))
    if len(phrase) == 1:
        return last.groupBy("id").agg(F.sum("n").alias("f"))
    starts = lambda rows, i: rows.select("id", F.explode(F.transform("places", lambda p: p - i)).alias("at"))
    found = starts(last, len(phrase) - 1)
    for i, word in enumerate(phrase[:-1]):
        found = found.join(starts(index.filter(F.col("token") == word), i), ["id", "at"])
    return found.groupBy("id").agg(F.count("*").alias("f"))


def matches(index: DataFrame, query: str) -> DataFrame | None:
    """(id, f0, f1, ...) of the items that have all phrases; None if the query has none."""
    terms = query_terms(query)
    if not terms:
        return None
    found = None
    for i, phrase in enumerate(terms):
        hits = phrase_hits(index, phrase).withColumnRenamed("f", f"f{i}")
        found = hits if found is None else found.join(hits, "id")
    return found


def _pattern(phrase: list[str]) -> str:
    """A regular expression on lower-cased text that matches where a phrase begins: folded tokens, the last a prefix.

    A letter stands for all that fold to it, with any marks behind it. What follows the first token is looked
    at but not taken, so that phrases which overlap are all found.
    """
    def spelt(token: str) -> str:
        return "".join(f"[{''.join(map(re.escape, (c, *sorted(spellings(c)))))}]\\p{{M}}*" for c in token)

    rest = "".join(f"[^\\p{{L}}\\p{{N}}]+{spelt(t)}" + ("(?![\\p{L}\\p{N}])" if t is not phrase[-1] else "") for t in phrase[1:])
    first = spelt(phrase[0]) + (f"(?![\\p{{L}}\\p{{N}}])(?={rest})" if rest else "")
    return "(?<![\\p{L}\\p{N}]\\p{M}{0,9})" + first


def counted(items: DataFrame, terms: list[list[str]], columns: tuple[str, ...] = ("title", "description", "search_meta")) -> DataFrame:
    """(id, length, f0, f1, ...) of all items: their tokens, and how often they have each phrase; texts are not cut into words."""
    low = spread(items.select("id", *columns)).select("id", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])
    whole = lambda pattern: sum((F.regexp_count(F.col(f"t{i}"), F.lit(pattern)) for i in range(len(columns))), F.lit(0)).cast("long")
    return low.select("id", whole(WRITTEN).alias("length"), *[whole(_pattern(t)).alias(f"f{i}") for i, t in enumerate(terms)])


def ranked(items: DataFrame, query: str, index: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(id, rank) of the matching items; rank is BM25 negated, so that less is better."""
    terms = query_terms(query)
    if not terms:
        return items.select("id", F.lit(0.0).alias("rank")).limit(0)
    # One row of corpus figures, with document frequencies, is broadcast.
    if index is None:
        every = cut(counted(items, terms))
        whole = every.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
        found = every
        for i in range(len(terms)):
            found = found.filter(F.col(f"f{i}") > 0)
    else:
        sizes = lengths(items) if sizes is None else sizes
        whole, found = sizes.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")), None
        for i, h in enumerate([phrase_hits(index, t) for t in terms]):
            whole = whole.crossJoin(F.broadcast(h.agg(F.count("*").alias(f"n{i}"))))
            h = h.withColumnRenamed("f", f"f{i}")
            found = h if found is None else found.join(h, "id")
        found = found.join(sizes, "id")
    found, score = found.crossJoin(F.broadcast(whole)), F.lit(0.0)
    for i in range(len(terms)):
        raw = F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
        f = F.col(f"f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return found.select("id", (-score).alias("rank"))


def search(items: DataFrame, query: str, limit: int, offset: int = 0, index: DataFrame | None = None, sizes: DataFrame | None = None,
           corpus: DataFrame | None = None) -> DataFrame:
    """items with rank: one page in the total order (rank, capture_date descending with nulls last, id descending).

    items may be filtered; corpus (by default items) is what the ranks are made over.
    """
    scores = ranked(items if corpus is None else corpus, query, index, sizes)
    # Sums of floating-point terms may differ in their last digits; equal texts are to tie.
    hits = items.join(scores, "id").withColumn("rank", F.round("rank", 9))
    return hits.orderBy(F.col("rank"), *order()).offset(offset).limit(limit)


def snapshot(ordered: DataFrame, by: list, query: dict) -> DataFrame:
    """(token, pos, id) of at most SNAPSHOT_IDS rows of a result, frozen for paging; the token names the query."""
    token = hashlib.sha256(json.dumps(query, sort_keys=True).encode()).hexdigest()[:32]
    top = ordered.orderBy(*by).limit(SNAPSHOT_IDS)
    return top.select(F.lit(token).alias("token"), (F.row_number().over(Window.orderBy(*by)) - 1).alias("pos"), "id")


def snapshot_page(frozen: DataFrame, items: DataFrame, token: str, offset: int, limit: int) -> DataFrame:
    """A page of a snapshot, hydrated without filters."""
    part = frozen.filter((F.col("token") == token) & F.col("pos").between(offset, offset + limit - 1))
    return part.join(items, "id")


def smart_search(items: DataFrame, vectors: DataFrame, query: str, embed, limit: int, narrow=lambda rows: rows, model: str | None = None, min_score: float = 0.0) -> DataFrame:
    """items with origin, score and pos: exact hits first, then the query's nearest neighbours.

    Neighbours are found among all vectors and filtered afterwards, so a filter can leave fewer of them than
    the limit. Without a usable query vector (embed fails) the result is the exact one.
    """
    from keepsake.operators.vectors import knn, merge_hits

    kept = narrow(items)
    exact = kept.join(ranked(items, query), "id").withColumn("rank", F.round("rank", 9))
    exact = exact.select("id", F.row_number().over(Window.orderBy("rank", *order())).alias("pos"))
    try:
        near = knn(vectors, [float(x) for x in embed([query])[0]], limit, model)
    except Exception:  # a model that is missing or fails must not take exact search with it
        return kept.join(exact.withColumns({"origin": F.lit("exact"), "score": F.lit(None).cast("double")}), "id")
    return merge_hits(exact, near.join(kept.select("id"), "id", "left_semi"), limit, min_score).join(kept, "id")
