"""A categorisation run: places and themes side by side, and what became of each item."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators import places, themes
from keepsake.operators.graph import cut


@dataclass
class Categorised:
    """assignments (item_id, kind, source_key, name, confidence, explanation), categories (kind, source_key, name), statuses (id, status)."""

    assignments: DataFrame
    categories: DataFrame
    statuses: DataFrame


def categorise(items: DataFrame, texts: DataFrame, gazetteer: DataFrame | None, failed: DataFrame | None = None, metres: float = places.EPS_METRES,
               min_points: int = places.MIN_POINTS, threshold: float = themes.THRESHOLD, min_size: int = themes.MIN_SIZE) -> Categorised:
    """Places of the items (id, lat, lon, vector) that have coordinates and themes of those that have a vector, named from texts (id, text).

    An item may have both. Its status is error where its categories could not be written (failed, by id), done
    where it has a category or a signal without one, and skipped where it has no signal. Without a gazetteer
    there are no places.
    """
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    place = places.plan(items.filter(there).select("id", "lat", "lon"), gazetteer, metres, min_points)
    members = cut(themes.clusters_in_blocks(items.filter("vector is not null").select("id", "vector"), threshold, min_size))
    theme = themes.plan(members, themes.labels_in(texts, members))
    columns = ["item_id", "kind", "source_key", "name", "confidence", "explanation"]
    found = cut(place.withColumn("kind", F.lit("place")).select(*columns).unionByName(theme.withColumn("kind", F.lit("theme")).select(*columns)))
    none = found.select(F.col("item_id").alias("id")).limit(0) if failed is None else failed.select("id")
    statuses = themes.item_statuses(items.select("id", (there | F.col("vector").isNotNull()).alias("has_signal")), found, none)
    return Categorised(found, found.select("kind", "source_key", "name").distinct(), statuses)
