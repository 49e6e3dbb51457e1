"""Assignments, suggestions and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_MEMBERS = 3
EXAMPLES = 4
KINDS = ("place", "theme")


def effective(assignments: DataFrame) -> DataFrame:
    """One row an (item, category): the user's where there is one, else the automatic one. Removals are rows too."""
    others = [c for c in assignments.columns if c not in ("item_id", "category_id")]
    best = F.max_by(F.struct(*others), F.col("source") == "user").alias("a")
    return assignments.groupBy("item_id", "category_id").agg(best).select("item_id", "category_id", *[F.col(f"a.{c}").alias(c) for c in others])


def members(assignments: DataFrame) -> DataFrame:
    """(item_id, category_id, ...) that are in effect and not removed."""
    return effective(assignments).filter("state = 'assigned'")


def chips(assignments: DataFrame, categories: DataFrame) -> DataFrame:
    """Each item's categories in effect, with kind and name; order by kind, name, id within the item."""
    own = categories.select(F.col("id").alias("category_id"), "kind", "name")
    return members(assignments).join(own, "category_id")


def candidates(assignments: DataFrame, categories: DataFrame, collections: DataFrame, min_members: int = MIN_MEMBERS) -> DataFrame:
    """(category_id, kind, name, member_count): places and themes with enough members that were neither accepted nor dismissed."""
    settled = collections.filter(F.col("category_id").isNotNull() & F.col("origin").isin("suggested", "dismissed")).select("category_id")
    open_ = categories.filter(F.col("kind").isin(*KINDS)).select(F.col("id").alias("category_id"), "kind", "name").join(settled, "category_id", "left_anti")
    counts = members(assignments).groupBy("category_id").agg(F.count("*").alias("member_count")).filter(F.col("member_count") >= min_members)
    return open_.join(counts, "category_id")


def examples(assignments: DataFrame, chosen: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """(category_id, item_id, place): the first members by id of each chosen category.

    Members are ranked in parts of a category before the category's few best meet, so that a category
    which holds a third of all items is not sorted in one task.
    """
    found = members(assignments).join(chosen.select("category_id"), "category_id", "left_semi").select("category_id", "item_id")
    part = F.pmod(F.xxhash64("item_id"), F.lit(64))
    first = found.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("category_id", "_p").orderBy("item_id"))).filter(F.col("_r") <= n)
    last = F.row_number().over(Window.partitionBy("category_id").orderBy("item_id"))
    return first.select("category_id", "item_id").withColumn("place", last).filter(F.col("place") <= n)


def merge_targets(collections: DataFrame) -> DataFrame:
    return collections.filter(F.col("origin").isin("user", "suggested")).select("id", "name", "origin")


def listed(collections: DataFrame, collection_items: DataFrame) -> DataFrame:
    """(id, name, cover_item_id, item_count) of collections that were not dismissed, empty ones included."""
    counts = collection_items.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("item_count"))
    return collections.filter("origin <> 'dismissed'").join(counts, "id", "left").select("id", "name", "cover_item_id", F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"))


def by_name(*more):
    """ASCII case-blind name, then id."""
    lower = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*more, lower, F.col("id")]


def member_page(collection_items: DataFrame, items: DataFrame, collection_id, limit: int, offset: int = 0) -> DataFrame:
    """A page of a collection's items: by position (those without one last), then time of adding, then id."""
    mine = collection_items.filter(F.col("collection_id") == F.lit(collection_id)).select(F.col("item_id").alias("id"), "position", "added_at")
    return mine.join(items, "id").orderBy(F.col("position").asc_nulls_last(), "added_at", "id").offset(offset).limit(limit)


def accept(assignments: DataFrame, categories: DataFrame, collections: DataFrame, category_id, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new collections, new members) from a suggestion; none if it has been accepted already."""
    before = collections.filter((F.col("category_id") == F.lit(category_id)) & (F.col("origin") == "suggested"))
    fresh = categories.filter(F.col("id") == F.lit(category_id)).select(F.col("id").alias("category_id"), F.coalesce(F.lit(name), "name").alias("name")).join(
        before, "category_id", "left_anti")
    made = fresh.select(F.concat(F.lit("suggested:"), F.col("category_id").cast("string")).alias("id"), "name", F.lit("suggested").alias("origin"), "category_id")
    rows = members(assignments).join(made.select(F.col("id").alias("collection_id"), "category_id"), "category_id").select("collection_id", "item_id")
    return made, rows


def merge_collections(collections: DataFrame, collection_items: DataFrame, source_id, target_id) -> tuple[DataFrame, DataFrame]:
    """(collections, collection_items) with source's members in target, once each, and source gone.

    Source's category is dismissed by a tombstone, so that it is not suggested again. A merge with itself is an error.
    """
    if source_id == target_id:
        raise ValueError("a collection cannot be merged into itself")
    moved = collection_items.filter(F.col("collection_id") == F.lit(source_id)).withColumn("collection_id", F.lit(target_id))
    mine = collection_items.filter(F.col("collection_id") == F.lit(target_id))
    rest = collection_items.filter(F.col("collection_id") != F.lit(source_id))
    new = moved.join(mine.select("item_id"), "item_id", "left_anti").select(*rest.columns)
    stone = collections.filter((F.col("id") == F.lit(source_id)) & F.col("category_id").isNotNull()).join(
        collections.filter("origin = 'dismissed'").select("category_id"), "category_id", "left_anti").select(*collections.columns)
    stone = stone.withColumns({"id": F.concat(F.lit("dismissed:"), F.col("category_id").cast("string")), "origin": F.lit("dismissed")})
    return collections.filter(F.col("id") != F.lit(source_id)).unionByName(stone), rest.unionByName(new)


def dismiss(collections: DataFrame, categories: DataFrame, category_id) -> DataFrame:
    """collections with a memberless tombstone for the category, once."""
    stone = categories.filter(F.col("id") == F.lit(category_id)).select(
        F.concat(F.lit("dismissed:"), F.col("id").cast("string")).alias("id"), "name", F.lit("dismissed").alias("origin"), F.col("id").alias("category_id"))
    new = stone.join(collections.filter("origin = 'dismissed'").select("category_id"), "category_id", "left_anti")
    return collections.unionByName(new, allowMissingColumns=True)


def accept_and_merge(assignments: DataFrame, categories: DataFrame, collections: DataFrame, collection_items: DataFrame, category_id, target_id) -> tuple[DataFrame, DataFrame]:
    """(collections, collection_items) with a suggestion's members put straight into a collection; nothing changes if it was accepted before."""
    made, rows = accept(assignments, categories, collections, category_id)
    return merge_collections(collections.unionByName(made, allowMissingColumns=True), collection_items.unionByName(rows, allowMissingColumns=True), f"suggested:{category_id}", target_id)


def upsert_categories(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Categories (id, kind, name, source_key) after delta, which carries seq: a known key takes the last name alone; a row without a key is always new."""
    rows = current.select("id", "kind", "name", "source_key", F.lit(-1).cast("long").alias("seq")).unionByName(delta.select("id", "kind", "name", "source_key", F.col("seq").cast("long")))
    keyed = rows.filter("source_key is not null").groupBy("source_key").agg(F.min_by("id", "seq").alias("id"), F.min_by("kind", "seq").alias("kind"), F.max_by("name", "seq").alias("name"))
    return keyed.unionByName(rows.filter("source_key is null").drop("seq"))


def assign_auto(assignments: DataFrame, delta: DataFrame) -> DataFrame:
    """assignments after automatic ones (item_id, category_id, seq and other columns): the last of a pair replaces its automatic row; users' rows stay."""
    own = [c for c in assignments.columns if c in delta.columns and c not in ("item_id", "category_id", "source", "state")]
    new = delta.groupBy("item_id", "category_id").agg(F.max("seq").alias("_s"), *[F.max_by(c, "seq").alias(c) for c in own]).drop("_s").withColumns({"source": F.lit("auto"), "state": F.lit("assigned")})
    kept = assignments.join(new.select("item_id", "category_id", "source"), ["item_id", "category_id", "source"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).select(*assignments.columns)


def rename(collections: DataFrame, collection_id, name: str) -> DataFrame:
    if not collections.filter(F.col("id") == F.lit(collection_id)).limit(1).count():
        raise ValueError("no such collection")
    return collections.withColumn("name", F.when(F.col("id") == F.lit(collection_id), name).otherwise(F.col("name")))


def corrections(assignments: DataFrame, changes: DataFrame) -> DataFrame:
    """assignments after user corrections (item_id, category_id, state, seq): the user's rows are set, automatic ones stay."""
    user = changes.groupBy("item_id", "category_id").agg(F.max_by("state", "seq").alias("state")).withColumn("source", F.lit("user"))
    kept = assignments.join(user.select("item_id", "category_id", "source"), ["item_id", "category_id", "source"], "left_anti")
    return kept.unionByName(user, allowMissingColumns=True).select(*assignments.columns)


def reassign(item_id, old, new, seq: int = 0) -> list[tuple]:
    """The two corrections of a move, to be applied together."""
    return [(item_id, old, "removed", seq), (item_id, new, "assigned", seq + 1)]
