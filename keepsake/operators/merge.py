"""Upserts as pure functions: current rows and a delta make the next rows.

A delta carries seq, its order of arrival. Every function can be applied twice with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import merge_token_lists

#: Columns of an item that the first non-null value wins, each by itself.
FIRST_WINS = ("title", "description", "capture_date", "capture_date_src", "gps_lat", "gps_lon", "duration_sec", "mime_type", "byte_size")


def _first(name: str, order: str = "seq") -> Column:
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order)))


def _last(name: str, order: str = "seq") -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order)))


def upsert_items(delta: DataFrame, columns: tuple[str, ...] = FIRST_WINS, keep: tuple[str, ...] = ("id", "media_type")) -> DataFrame:
    """Items by content_hash: first non-null value a column, search_meta merged token by token, `keep` of the first row.

    Rows without a hash stay apart. Current rows are part of delta with a smaller seq.
    """
    own = [c for c in columns if c in delta.columns]
    # A null hash is a key of its own row.
    key = F.coalesce(F.concat(F.lit("h"), "content_hash"), F.concat(F.lit("s"), F.col("seq").cast("string")))
    aggs = [F.min_by(c, "seq").alias(c) for c in keep] + [_first(c).alias(c) for c in own]
    made = delta.groupBy(key.alias("_k"), "content_hash").agg(*aggs)
    if "search_meta" not in delta.columns:
        return made.drop("_k")
    # Tokens are taken once a key before they meet, so that a hash of any number of rows gathers its distinct tokens alone.
    each = delta.filter("search_meta is not null").select(key.alias("_k"), "seq", F.posexplode(F.split("search_meta", r"\s+")).alias("_at", "_token")).filter("_token <> ''")
    first = each.groupBy("_k", "_token").agg(F.min(F.struct("seq", "_at")).alias("_first"))
    merged = first.groupBy("_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_token"))), lambda x: x["_token"]), " ").alias("search_meta"))
    return made.join(merged, "_k", "left").drop("_k")


def insert_ignore(current: DataFrame, delta: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """current with delta's first row of each new key."""
    first = delta.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in current.columns if c not in keys])
    return current.unionByName(first.join(current, keys, "left_anti").select(*current.columns))


def upsert_last(rows: DataFrame, keys: list[str], overwrite: tuple[str, ...] = (), coalesce: tuple[str, ...] = (), order: str = "seq") -> DataFrame:
    """One row a key: the last value of `overwrite` columns, the last non-null value of `coalesce` columns, the first of others."""
    others = [c for c in rows.columns if c not in {*keys, *overwrite, *coalesce, order}]
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in overwrite], *[_last(c, order).alias(c) for c in coalesce],
                                   *[F.min_by(c, order).alias(c) for c in others])


def set_favourites(items: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items after changes (id, favourite), ids that name no item)."""
    own = changes.select("id", F.col("favourite").alias("_f"))
    done = items.join(own, "id", "left").withColumn("is_favourite", F.coalesce("_f", "is_favourite")).drop("_f")
    return done, changes.join(items, "id", "left_anti").select("id")


def settle(items: DataFrame, settled: DataFrame, column: str) -> DataFrame:
    """items whose pending status in `column` takes that of settled (id, status)."""
    new = settled.select("id", F.col("status").alias("_s"))
    return items.join(new, "id", "left").withColumn(
        column, F.when((F.col(column) == "pending") & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col(column))).drop("_s")


def save_transcripts(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    """items with the text of transcripts (item_id, text) merged into search_meta and status done; done ones stay as they are."""
    new = transcripts.select(F.col("item_id").alias("id"), F.col("text").alias("_t"))
    takes = F.col("_t").isNotNull() & (F.col("transcript_status") != "done")
    return items.join(new, "id", "left").withColumns({
        "search_meta": F.when(takes, merge_token_lists(F.array("search_meta", "_t"))).otherwise(F.col("search_meta")),
        "transcript_status": F.when(takes, "done").otherwise(F.col("transcript_status"))}).drop("_t")


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not empty and finite."""
    return vectors.filter((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def replace_vectors(current: DataFrame, delta: DataFrame) -> DataFrame:
    """(item_id, model_id, vector) after delta, which carries seq: the last usable vector replaces its item's of that model; others change nothing."""
    new = valid_vectors(delta).groupBy("item_id", "model_id").agg(F.max_by("vector", "seq").alias("vector"))
    return current.select("item_id", "model_id", "vector").join(new, ["item_id", "model_id"], "left_anti").unionByName(new)


def remove_source(sources: DataFrame, items: DataFrame, occurrences: DataFrame, source_id) -> dict[str, DataFrame]:
    """The tables after an import is undone, and the blobs (content_hash) that nothing refers to any more.

    Occurrences of the source go, then items without any left; items of other sources stay, whoever brought them.
    """
    gone = occurrences.filter(F.col("source_id") == F.lit(source_id))
    left = occurrences.filter(F.col("source_id") != F.lit(source_id))
    orphans = gone.select("item_id").distinct().join(left, "item_id", "left_anti").select(F.col("item_id").alias("id"))
    kept = items.join(orphans, "id", "left_anti")
    hashes = lambda t: t.filter("content_hash is not null").select("content_hash")
    blobs = hashes(items.join(orphans, "id", "left_semi")).distinct().join(hashes(kept), "content_hash", "left_anti")
    return {"sources": sources.filter(F.col("id") != F.lit(source_id)), "items": kept, "occurrences": left, "blobs": blobs}


def remove_occurrence(items: DataFrame, occurrences: DataFrame, occurrence_id) -> dict[str, DataFrame]:
    gone = occurrences.filter(F.col("id") == F.lit(occurrence_id))
    left = occurrences.filter(F.col("id") != F.lit(occurrence_id))
    orphans = gone.select("item_id").join(left, "item_id", "left_anti").select(F.col("item_id").alias("id"))
    return {"items": items.join(orphans, "id", "left_anti"), "occurrences": left}


def original_path(content_hash: Column, ext: Column) -> Column:
    """originals/<first two>/<hash><ext>."""
    return F.concat(F.lit("originals/"), F.substring(content_hash, 1, 2), F.lit("/"), content_hash, F.coalesce(ext, F.lit("")))


def orphaned_blobs(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """Blobs (content_hash, ext) that no content-addressed occurrence refers to."""
    return blobs.join(references, ["content_hash", "ext"], "left_anti")
