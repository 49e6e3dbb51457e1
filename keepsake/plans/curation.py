"""Assignments, suggestions, collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.operators import curation as c
from keepsake.plans import tables as t


def effective_assignments(s, d):
    return c.effective(t.assignments(s, d))


def effective_members(s, d):
    return c.members(t.assignments(s, d)).select("item_id", "category_id")


def item_chips(s, d):
    return c.chips(t.assignments(s, d), t.categories(s, d)).select("item_id", "category_id", "kind", "name")


def suggestion_candidates(s, d):
    return c.candidates(t.assignments(s, d), t.categories(s, d), t.collections(s, d))


def suggestion_examples(s, d):
    a = t.assignments(s, d)
    return c.examples(a, c.candidates(a, t.categories(s, d), t.collections(s, d)))


def merge_targets(s, d):
    return c.merge_targets(t.collections(s, d))


def collections_list(s, d):
    found = c.listed(t.collections(s, d), t.collection_items(s, d))
    return found.withColumn("place", F.row_number().over(Window.orderBy(*c.by_name())))


def collection_members(s, d):
    page = c.member_page(t.collection_items(s, d), t.items(s, d), "c7", 10, 5)
    return page.select("id", "position", "added_at", "media_type")


def accept_suggestion(s, d):
    made, rows = c.accept(t.assignments(s, d), t.categories(s, d), t.collections(s, d), 29, "Kept")
    return rows.join(made.select(F.col("id").alias("collection_id"), "name", "origin"), "collection_id")


def merge_collections(s, d):
    """The memberships after a merge, each third item being in the next collection but one too; dismissed collections with no item."""
    rows = t.collection_items(s, d).select("collection_id", "item_id")
    second = rows.filter("item_id % 3 = 0").withColumn("collection_id", F.concat(F.lit("c"), ((F.col("item_id") + 2) % 20).cast("string")))
    cols, rows = c.merge_collections(t.collections(s, d), rows.union(second), "c4", "c6")
    return rows.unionByName(cols.filter("origin = 'dismissed'").select(F.col("id").alias("collection_id"), F.lit(None).cast("long").alias("item_id")))


def dismiss_suggestion(s, d):
    cols = c.dismiss(c.dismiss(t.collections(s, d), t.categories(s, d), 33), t.categories(s, d), 33)
    return cols.select("id", "name", "origin", "category_id")


def apply_corrections(s, d):
    changes = t.table(s, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 40).alias("category_id"),
                                             F.when(F.col("toxic") == 1, "removed").otherwise("assigned").alias("state"), F.lit(0).alias("seq"))
    return c.corrections(t.assignments(s, d), changes)


QUERIES = {f.__name__: f for f in (effective_assignments, effective_members, item_chips, suggestion_candidates, suggestion_examples, merge_targets, collections_list,
                                   collection_members, accept_suggestion, merge_collections, dismiss_suggestion, apply_corrections)}

_CANDIDATES = """candidates AS (SELECT g.id AS category_id, kind, name, count(*) AS member_count FROM categories g JOIN members m ON m.category_id = g.id
  WHERE kind IN ('place', 'theme') AND NOT EXISTS (SELECT 1 FROM collections k WHERE k.category_id = g.id AND k.origin IN ('suggested', 'dismissed')) GROUP BY ALL HAVING count(*) >= 3)"""
_ALL = f"WITH {t.ASSIGNMENTS}, {t.CATEGORIES}, {t.COLLECTIONS}"

ORACLE_SQL = {
    "effective_assignments": f"WITH {t.ASSIGNMENTS} SELECT item_id, category_id, source, state FROM effective",
    "effective_members": f"WITH {t.ASSIGNMENTS} SELECT * FROM members",
    "item_chips": f"{_ALL} SELECT item_id, category_id, kind, name FROM members m JOIN categories g ON g.id = m.category_id",
    "suggestion_candidates": f"{_ALL}, {_CANDIDATES} SELECT * FROM candidates",
    "suggestion_examples": f"""{_ALL}, {_CANDIDATES} SELECT category_id, item_id, CAST(r AS INT) AS place FROM (SELECT m.category_id, item_id, row_number() OVER (PARTITION BY m.category_id ORDER BY item_id) AS r
      FROM members m JOIN candidates USING (category_id)) WHERE r <= 4""",
    "merge_targets": f"WITH {t.COLLECTIONS} SELECT id, name, origin FROM collections WHERE origin IN ('user', 'suggested')",
    "collections_list": f"""WITH {t.COLLECTIONS}, {t.COLLECTION_ITEMS} SELECT id, name, cover_item_id, (SELECT count(*) FROM collection_items i WHERE i.collection_id = k.id) AS item_count,
      CAST(row_number() OVER (ORDER BY lower(name), id) AS INT) AS place FROM collections k WHERE origin <> 'dismissed'""",
    "collection_members": f"""WITH {t.ITEMS}, {t.COLLECTION_ITEMS} SELECT i.id, position, added_at, media_type FROM collection_items k JOIN items i ON i.id = k.item_id WHERE collection_id = 'c7'
      ORDER BY position NULLS LAST, added_at, i.id LIMIT 10 OFFSET 5""",
    "accept_suggestion": f"""{_ALL} SELECT 'suggested:29' AS collection_id, item_id, 'Kept' AS name, 'suggested' AS origin FROM members WHERE category_id = 29
      AND NOT EXISTS (SELECT 1 FROM collections WHERE category_id = 29 AND origin = 'suggested')""",
    "merge_collections": f"""WITH {t.COLLECTIONS}, {t.COLLECTION_ITEMS}, r AS (SELECT collection_id, item_id FROM collection_items UNION ALL SELECT 'c' || ((item_id + 2) % 20), item_id FROM collection_items WHERE item_id % 3 = 0)
      SELECT * FROM r WHERE collection_id <> 'c4' UNION ALL SELECT 'c6', item_id FROM r WHERE collection_id = 'c4' AND item_id NOT IN (SELECT item_id FROM r WHERE collection_id = 'c6')
      UNION ALL SELECT id, NULL FROM collections WHERE origin = 'dismissed' AND id <> 'c4' UNION ALL SELECT 'dismissed:4', NULL""",
    "dismiss_suggestion": f"""{_ALL} SELECT id, name, origin, category_id FROM collections UNION ALL SELECT 'dismissed:' || id, name, 'dismissed', id FROM categories WHERE id = 33""",
    "apply_corrections": f"""WITH {t.ASSIGNMENTS}, u AS (SELECT doc_id AS item_id, doc_id % 40 AS category_id, 'user' AS source, CASE WHEN toxic = 1 THEN 'removed' ELSE 'assigned' END AS state FROM labels)
      SELECT * FROM u UNION ALL SELECT item_id, category_id, source, state FROM assignments a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.item_id = a.item_id AND u.category_id = a.category_id AND u.source = a.source)""",
}
