"""Item filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.schemas import DESCRIPTION_CHARS, TABLES, TITLE_CHARS


def by_type(items: DataFrame, types: list[str] | None) -> DataFrame:
    return items.filter(F.col("media_type").isin(*types)) if types else items


def by_date(items: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bounds are days, the end inclusive; an undated row fails any bound."""
    if start:
        items = items.filter(F.col("capture_date") >= start)
    return items.filter(F.col("capture_date") <= f"{end}T23:59:59.999Z") if end else items


def by_source(items: DataFrame, occurrences: DataFrame, sources: DataFrame, source: str | None) -> DataFrame:
    """Items with some occurrence in a source of that type."""
    if not source:
        return items
    mine = occurrences.join(sources.filter(F.col("type") == source).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return items.join(mine.select(F.col("item_id").alias("id")), "id", "left_semi")


def by_ids(items: DataFrame, ids_json: str) -> DataFrame:
    """Items whose id is in a JSON array; order is not kept, unknown ids are passed over."""
    wanted = items.sparkSession.range(1).select(F.explode(F.from_json(F.lit(ids_json), f"array<{items.schema['id'].dataType.simpleString()}>")).alias("id"))
    return items.join(wanted.distinct(), "id", "left_semi")


def pending(items: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """The work queue of a drain: items whose status in `column` is pending, by id."""
    rows = items.filter(F.col(column) == "pending")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def categorizable(items: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """(id, lat, lon, vector) of items that wait for a category; a vector counts only where embedding is done."""
    own = embeddings.filter(F.col("model_id") == model).select(F.col("item_id").alias("id"), "vector")
    return pending(items, "category_status").join(own, "id", "left").select(
        "id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"), F.when(F.col("embed_status") == "done", F.col("vector")).alias("vector"))


def transcripts_of(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(id, status, text, language): only the status until it is done; done without a usable row shows as pending."""
    t = transcripts.select(F.col("item_id").alias("id"), "text", "language")
    done = (F.col("transcript_status") == "done") & F.col("text").isNotNull()
    status = F.when((F.col("transcript_status") == "done") & F.col("text").isNull(), "pending").otherwise(F.col("transcript_status"))
    return items.join(t, "id", "left").select("id", status.alias("status"), F.when(done, F.col("text")).alias("text"), F.when(done, F.col("language")).alias("language"))


def first_sources(occurrences: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, source): the type of each item's earliest occurrence by (created_at, id)."""
    first = occurrences.groupBy("item_id").agg(F.min(F.struct("created_at", "id", "source_id")).alias("o"))
    return first.select("item_id", F.col("o.source_id").alias("source_id")).join(
        sources.select(F.col("id").alias("source_id"), F.col("type").alias("source")), "source_id").select("item_id", "source")


def servable_originals(occurrences: DataFrame) -> DataFrame:
    """(item_id, stored_path): originals in place before content-addressed ones, then by (created_at, id)."""
    rank = F.struct((F.col("storage_mode") != "in_place").alias("copied"), "created_at", "id", "stored_path")
    return occurrences.groupBy("item_id").agg(F.min(rank).alias("o")).select("item_id", F.col("o.stored_path").alias("stored_path"))


def cards(items: DataFrame) -> DataFrame:
    """Items as list entries: bounded title and description, has_thumbnail."""
    return items.select("id", "media_type", F.substring("title", 1, TITLE_CHARS).alias("title"), F.substring("description", 1, DESCRIPTION_CHARS).alias("description"),
                        "capture_date", F.coalesce(F.col("thumb_status") == "done", F.lit(False)).alias("has_thumbnail"))


def transcribable(items: DataFrame) -> DataFrame:
    return items.filter(F.col("media_type").isin("audio", "video"))


def with_overrides(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Items whose favourite flag settled overrides (id, favourite) replace."""
    own = overrides.select("id", F.col("favourite").alias("_o"))
    return items.join(own, "id", "left").withColumn("is_favourite", F.coalesce("_o", "is_favourite")).drop("_o")


#: Columns of an item as the catalog shows it, in their order.
ITEM_COLUMNS = tuple(c.split()[0] for c in TABLES["items"].split(", "))


def item_view(items: DataFrame) -> DataFrame:
    """Items with all columns of ITEM_COLUMNS and no others; a column that is not there is null, a favourite is false unless said."""
    kinds = dict(c.split() for c in TABLES["items"].split(", "))
    found = items.select(*[(F.col(c) if c in items.columns else F.lit(None).cast(kinds[c])).alias(c) for c in ITEM_COLUMNS])
    return found.withColumn("is_favourite", F.coalesce("is_favourite", F.lit(False)))


def category_by_id(categories: DataFrame, category_id) -> DataFrame:
    return categories.filter(F.col("id") == F.lit(category_id))


def category_by_source_key(categories: DataFrame, key: str) -> DataFrame:
    """The category of a source key; the smallest id should several have it."""
    return categories.filter(F.col("source_key") == F.lit(key)).orderBy("id").limit(1)


def ingestion_summary(occurrences: DataFrame, skips: DataFrame | None = None, by: str = "source_id") -> DataFrame:
    """(by, records, items_touched, retained, in_place, skipped) of an import's occurrences (item_id, storage_mode) and skips, which carry `by`."""
    mode = lambda m: F.count_if(F.col("storage_mode") == m)
    made = occurrences.groupBy(by).agg(F.count("*").alias("records"), F.countDistinct("item_id").alias("items_touched"), mode("content_addressed").alias("retained"), mode("in_place").alias("in_place"))
    if skips is None:
        return made.withColumn("skipped", F.lit(0).cast("long"))
    lost = skips.groupBy(by).agg(F.count("*").alias("skipped"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return made.join(lost, by, "full").select(by, *[zero(c) for c in ("records", "items_touched", "retained", "in_place", "skipped")])
