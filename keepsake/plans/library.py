"""What a library does with its catalog: smart search, views, writes, index upkeep, tallies."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from keepsake.operators import curation, filters, merge, search, speech, timeline, vectors
from keepsake.operators.graph import shared_folder
from keepsake.operators.stored import StoredIndex
from keepsake.plans import tables as t
from keepsake.plans.analytics import _KNN, MERGED_HITS, _query, _vectors
from keepsake.plans.catalog import _ORDER, _TOK, _bm25



def smart_search(s, d):
    """Exact hits and neighbours of a query vector, among photos and audio."""
    found = search.smart_search(t.items(s, d), _vectors(s, d), "heat", lambda _: [_query(s, d)], 60, lambda rows: filters.by_type(rows, ["photo", "audio"]))
    return found.select("id", "origin", F.round("score", 6).alias("score"), "pos", "media_type")


def timeline_next_page(s, d):
    """The page behind the cursor of the first page."""
    items = t.items(s, d).select("id", "capture_date")
    cursor = timeline.next_cursor(timeline.page(items, 50).collect(), 50)
    if cursor is None:
        return items.limit(0)
    return timeline.page(items, 50, timeline.decode_cursor(timeline.encode_cursor(cursor)))


def hydrate_ids(s, d):
    return filters.by_ids(t.items(s, d), json.dumps([*range(0, 400, 7), 10**12])).select("id", "media_type", "capture_date")


def pending_embeddings(s, d):
    return filters.pending(t.items(s, d).select("id", F.when(F.col("id") % 5 == 0, "done").otherwise("pending").alias("embed_status")), "embed_status", 200).select("id")


def transcribable_items(s, d):
    return filters.transcribable(t.items(s, d)).select("id", "media_type")


def categorizable_items(s, d):
    """Coordinates and vectors of items without a category; a vector shows only where embedding is done."""
    k = F.col("id")
    items = t.points(s, d).select("id", F.col("lat").alias("gps_lat"), F.col("lon").alias("gps_lon"), F.when(k % 3 == 0, "done").otherwise("pending").alias("category_status"), F.when(k % 2 == 0, "done").otherwise("error").alias("embed_status"))
    rows = filters.categorizable(items, _vectors(s, d).withColumnRenamed("id", "item_id"), "m1")
    return rows.select("id", "lat", "lon", F.coalesce(F.size("vector"), F.lit(0)).alias("dim"))


def transcript_views(s, d):
    status = F.element_at(F.array(*map(F.lit, ("done", "pending", "failed"))), (F.col("id") % 3 + 1).cast("int"))
    first = t.table(s, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("item_id"), "text", F.lit("en").alias("language"))
    return filters.transcripts_of(t.items(s, d).select("id", status.alias("transcript_status")), first).select("id", "status", F.md5("text").alias("text_md5"), "language")


def favourite_changes(s, d):
    """Flags set by labels; toxic ones name no item."""
    items = t.items(s, d).select("id", (F.col("id") % 4 == 0).alias("is_favourite"))
    changes = t.table(s, d, "labels").select((F.col("doc_id") + F.col("toxic").cast("long") * 10**12).alias("id"), (F.col("quality") == 1).alias("favourite"))
    done, unknown = merge.set_favourites(items, changes)
    return done.select("id", "is_favourite").union(unknown.select("id", F.lit(None).cast("boolean")))


def undo_occurrence(s, d):
    left = merge.remove_occurrence(t.items(s, d), t.occurrences(s, d), 4)
    return left["items"].select(F.lit("item").alias("what"), "id").union(left["occurrences"].select(F.lit("occurrence"), "id"))


def embedding_replace(s, d):
    """Vectors by (item, model) after a second run, in which some are empty or not finite."""
    old = _vectors(s, d).withColumnRenamed("id", "item_id")
    k = F.col("item_id")
    spoilt = F.when(k % 5 == 0, F.slice("vector", 1, 0)).when(k % 5 == 1, F.transform("vector", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.slice("vector", 1, 16))
    new = old.select("item_id", "model_id", spoilt.alias("vector"), F.lit(1).alias("seq")).union(old.select("item_id", F.lit("m2"), F.slice("vector", 1, 8), F.lit(2)))
    return merge.replace_vectors(old, new).select("item_id", "model_id", F.size("vector").alias("dim"), F.round(vectors.dot(F.col("vector"), F.col("vector")), 4).alias("length"))


def vector_round_trip(s, d):
    blob = F.pandas_udf(lambda v: v.map(vectors.encode_vector), "binary")("vector")
    v = _vectors(s, d).select("id", "vector", blob.alias("blob")).withColumn("back", vectors.decode_vectors(F.col("blob")))
    return v.select("id", F.length("blob").alias("bytes"), F.size("back").alias("dim"), F.round(vectors.dot(F.col("vector"), F.col("back")), 4).alias("length"))


def category_upsert(s, d):
    """Categories by source key: customers first, renamed by each of their orders; rows without a key are new."""
    current = t.table(s, d, "customer").select(F.concat(F.lit("a"), "c_custkey").alias("id"), F.lit("theme").alias("kind"), F.col("c_name").alias("name"), F.concat(F.lit("k"), "c_custkey").alias("source_key"))
    delta = t.table(s, d, "orders").select(F.concat(F.lit("b"), "o_orderkey").alias("id"), F.lit("place").alias("kind"), F.concat(F.lit("b"), "o_orderkey", F.lit("!")).alias("name"),
                                           F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("k"), "o_custkey")).alias("source_key"), F.col("o_orderkey").alias("seq"))
    return curation.upsert_categories(current, delta).select("id", "kind", "name", "source_key")


def auto_assign(s, d):
    delta = t.table(s, d, "labels").select(F.col("doc_id").alias("item_id"), ((F.col("doc_id") + F.col("toxic")) % 40).alias("category_id"), F.lit(0).alias("seq"))
    return curation.assign_auto(t.assignments(s, d), delta)


def accept_and_merge(s, d):
    cols, rows = curation.accept_and_merge(t.assignments(s, d), t.categories(s, d), t.collections(s, d), t.collection_items(s, d).select("collection_id", "item_id"), 29, "c3")
    return rows.unionByName(cols.filter("origin = 'dismissed'").select(F.col("id").alias("collection_id"), F.lit(None).cast("long").alias("item_id")))


def collection_rename(s, d):
    return curation.rename(t.collections(s, d), "c7", "Renamed").select("id", "name")


def index_refresh(s, d):
    """The index after a third of the items got their texts and some were deleted; counts by token."""
    items = t.items(s, d)
    old = items.withColumn("description", F.when(F.col("id") % 3 == 0, "draft").otherwise(F.col("description")))
    index = search.refreshed(search.postings(old), items.filter("id % 3 = 0"), items.filter("id % 3 = 1 and id % 7 = 0"))
    return index.groupBy("token").agg(F.count("*").alias("items"), F.sum("n").alias("n"))


def stored_index_topk(s, d):
    """A ranked search of a stored index: items as drafts, then a segment that rewrites a third and takes some out, then a merge."""
    items = t.items(s, d)
    index = StoredIndex(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}")
    index.add(items.withColumn("description", F.when(F.col("id") % 3 == 0, "draft").otherwise(F.col("description"))))
    index.add(items.filter("id % 3 = 0"), items.filter("id % 3 = 1 and id % 7 = 0"))
    index.merge()
    live = items.filter("not (id % 3 = 1 and id % 7 = 0)")
    top = search.search(live, "the on", 30, index=index.postings(), sizes=index.sizes())
    return top.select("id", F.round("rank", 6).alias("score"))


def recognition_summary(s, d):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    rows = t.table(s, d, "lineitem").select(q.alias("words"), n.alias("substitutions"), (n % 3).alias("deletions"), (n % 2).alias("insertions"), F.col("l_discount").alias("rtf"), (n < 4).alias("detected"))
    rows = rows.withColumn("wer", (F.col("substitutions") + F.col("deletions") + F.col("insertions")) / F.nullif("words", F.lit(0)))
    return speech.summary(rows).select("n", *[F.round(c, 6).alias(c) for c in ("macro_wer", "micro_wer", "mean_rtf", "detection")])


def run_tally(s, d):
    return speech.tally(t.table(s, d, "events").select(F.col("event_type").alias("outcome")))


QUERIES = {f.__name__: f for f in (smart_search, timeline_next_page, hydrate_ids, pending_embeddings, transcribable_items, categorizable_items, transcript_views, favourite_changes, undo_occurrence, embedding_replace,
                                   vector_round_trip, category_upsert, auto_assign, accept_and_merge, collection_rename, index_refresh, stored_index_topk, recognition_summary, run_tally)}

_DOT = "round(list_dot_product({v}, {v}), 4)"

ORACLE_SQL = {
    "smart_search": _bm25(["heat"]) + f""", kept AS (SELECT id, media_type FROM items WHERE media_type IN ('photo', 'audio')), ex AS (SELECT id, CAST(row_number() OVER (ORDER BY rank, {_ORDER}) AS INT) AS pos FROM found WHERE media_type IN ('photo', 'audio')),
      nn AS (SELECT * FROM (SELECT id, score FROM ({_KNN}) ORDER BY score DESC, id LIMIT 60) WHERE id IN (SELECT id FROM kept)), {MERGED_HITS.format(limit=60)}
      SELECT id, origin, round(score, 6) AS score, pos, media_type FROM merged JOIN kept USING (id)""",
    "timeline_next_page": f"WITH {t.ITEMS} SELECT id, capture_date FROM items ORDER BY {_ORDER} LIMIT 50 OFFSET 50",
    "hydrate_ids": f"WITH {t.ITEMS} SELECT id, media_type, capture_date FROM items WHERE id < 400 AND id % 7 = 0",
    "pending_embeddings": "SELECT doc_id AS id FROM documents WHERE doc_id % 5 <> 0 ORDER BY doc_id LIMIT 200",
    "transcribable_items": f"WITH {t.ITEMS} SELECT id, media_type FROM items WHERE media_type IN ('audio', 'video')",
    "categorizable_items": f"""WITH {t.POINTS} SELECT p.id, lat, lon, CASE WHEN p.id % 2 = 0 THEN coalesce(len(embedding), 0) ELSE 0 END::INT AS dim FROM points p LEFT JOIN embeddings e ON e.vec_id = p.id AND e.label % 2 = 1 WHERE p.id % 3 <> 0""",
    "transcript_views": """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN c.text IS NULL THEN 'pending' ELSE 'done' END WHEN 1 THEN 'pending' ELSE 'failed' END AS status,
      CASE WHEN doc_id % 3 = 0 THEN md5(c.text) END AS text_md5, CASE WHEN doc_id % 3 = 0 AND c.text IS NOT NULL THEN 'en' END AS language FROM documents LEFT JOIN conversations c ON c.conv_id = doc_id AND turn = 0""",
    "favourite_changes": """SELECT d.doc_id AS id, CASE WHEN l.toxic = 0 THEN l.quality = 1 ELSE d.doc_id % 4 = 0 END AS is_favourite FROM documents d LEFT JOIN labels l USING (doc_id)
      UNION ALL SELECT doc_id + 1000000000000, NULL FROM labels WHERE toxic = 1""",
    "undo_occurrence": f"WITH {t.OCCURRENCES} SELECT 'item' AS what, doc_id AS id FROM documents WHERE doc_id <> 2 UNION ALL SELECT 'occurrence', id FROM occurrences WHERE id <> 4",
    "embedding_replace": f"""WITH r AS (SELECT vec_id AS item_id, 'm' || (label % 2) AS model_id, CASE WHEN vec_id % 5 < 2 THEN embedding ELSE embedding[1:16] END::DOUBLE[] AS v FROM embeddings
      UNION ALL SELECT vec_id, 'm2', embedding[1:8]::DOUBLE[] FROM embeddings) SELECT item_id, model_id, len(v)::INT AS dim, {_DOT.format(v='v')} AS length FROM r""",
    "vector_round_trip": f"SELECT vec_id AS id, (4 * len(embedding))::INT AS bytes, len(embedding)::INT AS dim, {_DOT.format(v='embedding::DOUBLE[]')} AS length FROM embeddings",
    "category_upsert": """WITH l AS (SELECT 'k' || o_custkey AS source_key, min(o_orderkey) AS f, max(o_orderkey) AS m FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey), c AS (SELECT c_custkey, c_name, 'k' || c_custkey AS source_key FROM customer)
      SELECT CASE WHEN c.source_key IS NULL THEN 'b' || f ELSE 'a' || c_custkey END AS id, CASE WHEN c.source_key IS NULL THEN 'place' ELSE 'theme' END AS kind, coalesce('b' || m || '!', c_name) AS name, coalesce(c.source_key, l.source_key) AS source_key
      FROM c FULL JOIN l ON l.source_key = c.source_key UNION ALL SELECT 'b' || o_orderkey, 'place', 'b' || o_orderkey || '!', NULL FROM orders WHERE o_orderkey % 7 = 0""",
    "auto_assign": f"""WITH {t.ASSIGNMENTS} SELECT item_id, category_id, source, state FROM assignments UNION ALL SELECT doc_id, (doc_id + toxic) % 40, 'auto', 'assigned' FROM labels
      WHERE toxic = 1 OR doc_id NOT IN (SELECT doc_id FROM documents)""",
    "accept_and_merge": f"""WITH {t.ASSIGNMENTS}, {t.COLLECTIONS}, {t.COLLECTION_ITEMS} SELECT collection_id, item_id FROM collection_items UNION ALL SELECT 'c3', item_id FROM members WHERE category_id = 29
      AND item_id NOT IN (SELECT item_id FROM collection_items WHERE collection_id = 'c3') UNION ALL SELECT id, NULL FROM collections WHERE origin = 'dismissed' UNION ALL SELECT 'dismissed:29', NULL WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id % 40 = 29)""",
    "collection_rename": f"WITH {t.COLLECTIONS} SELECT id, CASE WHEN id = 'c7' THEN 'Renamed' ELSE name END AS name FROM collections",
    "index_refresh": f"WITH {t.ITEMS}, {_TOK} SELECT t AS token, count(DISTINCT id) AS items, count(*) AS n FROM tok WHERE NOT (id % 3 = 1 AND id % 7 = 0) GROUP BY t",
    "stored_index_topk": _bm25(["the", "on"]).replace(t.ITEMS, t.ITEMS + ", every AS (SELECT * FROM items), live AS (SELECT * FROM every WHERE NOT (id % 3 = 1 AND id % 7 = 0))", 1).replace("FROM items", "FROM live").replace("JOIN items", "JOIN live").replace(
        "every AS (SELECT * FROM live)", "every AS (SELECT * FROM items)") + f", p AS (SELECT * FROM found ORDER BY rank, {_ORDER} LIMIT 30) SELECT id, round(rank, 6) AS score FROM p",
    "recognition_summary": """SELECT count(*) AS n, round(avg(e / nullif(w, 0)), 6) AS macro_wer, round(sum(e) / sum(w), 6) AS micro_wer, round(avg(l_discount), 6) AS mean_rtf, round(avg((l_linenumber < 4)::INT), 6) AS detection
      FROM (SELECT *, l_quantity::BIGINT AS w, l_linenumber + l_linenumber % 3 + l_linenumber % 2 AS e FROM lineitem)""",
    "run_tally": "SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY event_type",
}
