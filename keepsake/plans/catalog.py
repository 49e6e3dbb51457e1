"""Timeline, search, filters, provenance, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.operators import filters, merge, search, timeline
from keepsake.plans import tables as t

_TOK = r"""tok AS (SELECT id, col, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM (
  SELECT id, 0 AS col, regexp_extract_all(strip_accents(lower(title)), '[\p{L}\p{N}]+') AS ws FROM items
  UNION ALL SELECT id, 1, regexp_extract_all(strip_accents(lower(description)), '[\p{L}\p{N}]+') FROM items
  UNION ALL SELECT id, 2, regexp_extract_all(strip_accents(lower(search_meta)), '[\p{L}\p{N}]+') FROM items))"""


def _bm25(terms: list[str]) -> str:
    """SQL for (id, rank) of single-token prefix terms."""
    hits = [f"h{i} AS (SELECT id, count(*) AS f FROM tok WHERE starts_with(t, '{w}') GROUP BY id)" for i, w in enumerate(terms)]
    idf = [f"(SELECT CASE WHEN n < docs / 2.0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END FROM (SELECT count(*) AS n FROM h{i}), whole)" for i in range(len(terms))]
    score = " + ".join(f"{idf[i]} * h{i}.f * 2.2 / (h{i}.f + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(terms)))
    joins = "".join(f" JOIN h{i} USING (id)" for i in range(len(terms)))
    return (f"WITH {t.ITEMS}, {_TOK}, {', '.join(hits)}, sizes AS (SELECT i.id, coalesce(n, 0) AS length FROM items i LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) k ON k.id = i.id), "
            f"whole AS (SELECT count(*) AS docs, avg(length) AS mean FROM sizes), ranks AS (SELECT id, round(-({score}), 9) AS rank FROM sizes{joins}, whole), "
            "found AS (SELECT i.*, rank FROM ranks JOIN items i USING (id))")


_ORDER = "capture_date DESC NULLS LAST, id DESC"


def _rank():
    return [F.col("rank"), *timeline.order()]


def _timeline(cursor=None):
    def run(spark, d):
        rows = timeline.page(t.items(spark, d).select("id", "capture_date"), 50, cursor)
        return timeline.ranked(rows, *timeline.order())
    return run


def _timeline_sql(where: str) -> str:
    return f"WITH {t.ITEMS}, p AS (SELECT id, capture_date FROM items {where} ORDER BY {_ORDER} LIMIT 50) SELECT *, CAST(row_number() OVER (ORDER BY {_ORDER}) AS INT) AS rank FROM p"


def _search(query, limit=20, offset=0, narrow=lambda i: i):
    def run(spark, d):
        items = t.items(spark, d)
        top = search.search(narrow(items), query, limit, offset, corpus=items)
        return top.select("id", F.round("rank", 6).alias("score"), "capture_date", F.row_number().over(Window.orderBy(*_rank())).alias("place"))
    return run


def _search_sql(terms, where="", limit=20, offset=0) -> str:
    return (_bm25(terms) + f", p AS (SELECT * FROM found {where} ORDER BY rank, {_ORDER} LIMIT {limit} OFFSET {offset}) "
            f"SELECT id, round(rank, 6) AS score, capture_date, CAST(row_number() OVER (ORDER BY rank, {_ORDER}) AS INT) AS place FROM p")


def fts_prefix_and(spark, d):
    items = t.items(spark, d)
    return search.matches(search.postings(items), "the and re").select("id", "f0", "f1", "f2")


def fts_phrase(spark, d):
    """A term with a mark inside is a phrase of adjacent tokens, the last a prefix."""
    return search.matches(search.postings(t.items(spark, d)), "of-th").select("id", "f0")


def fts_count(spark, d):
    return search.matches(search.postings(t.items(spark, d)), "the and").agg(F.count("*").alias("n"))


def search_ids(spark, d):
    return search.search(t.items(spark, d), "und", 100).select("id")


def search_snapshot(spark, d):
    items = t.items(spark, d)
    hits = items.select("id", "capture_date").join(search.ranked(items, "with"), "id").withColumn("rank", F.round("rank", 9))
    frozen = search.snapshot(hits, _rank(), {"query": "with"})
    token = F.col("token")
    page = frozen.filter(F.col("pos").between(20, 39)).join(items, "id")
    return page.select(F.length(token).alias("token_length"), "pos", "id", "media_type")


def source_projection(spark, d):
    first = filters.first_sources(t.occurrences(spark, d), t.sources(spark, d))
    return t.items(spark, d).select("id").join(first.withColumnRenamed("item_id", "id"), "id", "left")


def source_filter(spark, d):
    return filters.by_source(t.items(spark, d).select("id"), t.occurrences(spark, d), t.sources(spark, d), "linkedin")


def servable_original(spark, d):
    return filters.servable_originals(t.occurrences(spark, d))


def item_cards(spark, d):
    items = t.items(spark, d).withColumn("thumb_status", F.when(F.col("id") % 3 == 0, "done").otherwise("pending"))
    return filters.cards(items).select("id", "media_type", F.length("title").alias("title_chars"), F.md5("description").alias("description_md5"), "has_thumbnail")


def dedup_content_hash(spark, d):
    delta = t.items(spark, d).withColumn("seq", F.col("id"))
    return merge.upsert_items(delta, ("capture_date",)).select("content_hash", "id", "media_type", "capture_date", "search_meta")


def dedup_null_hash(spark, d):
    delta = t.items(spark, d).select("id", "media_type", "capture_date", F.when(F.col("id") % 2 == 0, F.col("content_hash")).alias("content_hash"), F.col("id").alias("seq"))
    return merge.upsert_items(delta, ("capture_date",))


def merge_search_tokens(spark, d):
    """The search tokens of all turns of a conversation, in the order in which they were first said."""
    turns = t.table(spark, d, "conversations")
    lists = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return turns.groupBy("conv_id").agg(X.merge_token_lists(lists).alias("tokens")).select("conv_id", F.size(F.split("tokens", " ")).alias("n"), F.md5("tokens").alias("tokens_md5"))


def occurrence_idempotent(spark, d):
    seq = t.occurrences(spark, d).select("item_id", "source_id", F.col("id").alias("seq"), (F.col("id") % 5).alias("source_ref"))
    current = seq.filter("seq % 4 = 0").select("item_id", "source_id", "source_ref", F.lit("old").alias("origin"))
    current = current.groupBy("item_id", "source_id", "source_ref").agg(F.first("origin").alias("origin"))
    return merge.insert_ignore(current, seq.withColumn("origin", F.lit("new")), ["item_id", "source_id", "source_ref"])


def asset_upsert(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.lit("thumb").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
                                                F.concat(F.lit("t/"), F.col("l_orderkey").cast("string")).alias("path"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("width"))
    return merge.upsert_last(rows, ["item_id", "kind"], ("path",), ("width",))


def source_upsert(spark, d):
    rows = t.table(spark, d, "orders").select(F.col("o_custkey").alias("source_key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("label"),
                                              F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("original_path"))
    return merge.upsert_last(rows, ["source_key"], ("label",), ("original_path",))


def undo_source(spark, d):
    left = merge.remove_source(t.sources(spark, d), t.items(spark, d), t.occurrences(spark, d), "src3")
    return left["items"].select(F.lit("item").alias("what"), F.col("id").cast("string").alias("key")).union(
        left["blobs"].select(F.lit("blob"), "content_hash")).union(left["occurrences"].select(F.lit("occurrence"), F.col("id").cast("string")))


def orphan_blobs(spark, d):
    blobs = t.items(spark, d).select("content_hash", F.lit(".txt").alias("ext")).distinct()
    used = t.occurrences(spark, d).filter("storage_mode = 'content_addressed'").join(t.items(spark, d).select(F.col("id").alias("item_id"), "content_hash"), "item_id")
    return merge.orphaned_blobs(blobs, used.select("content_hash", F.lit(".txt").alias("ext")).distinct()).select(
        "content_hash", merge.original_path(F.col("content_hash"), F.col("ext")).alias("path"))


def import_summary(spark, d):
    occ = t.occurrences(spark, d)
    return occ.groupBy("source_id").agg(F.count("*").alias("records"), F.countDistinct("item_id").alias("items_touched"),
                                        F.sum(F.when(F.col("storage_mode") == "content_addressed", 1).otherwise(0)).alias("retained"))


def favourite_overrides(spark, d):
    items = t.items(spark, d).select("id", (F.col("id") % 4 == 0).alias("is_favourite"))
    over = t.table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("favourite"))
    return filters.with_overrides(items, over)


def transcript_save(spark, d):
    items = t.items(spark, d).select("id", "search_meta", F.when(F.col("id") % 6 == 0, "done").otherwise("pending").alias("transcript_status"))
    first = t.table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("item_id"), "text")
    return merge.save_transcripts(items, first).select("id", F.md5("search_meta").alias("meta_md5"), "transcript_status")


def status_settle(spark, d):
    items = t.items(spark, d).select("id", F.when(F.col("id") % 5 == 0, "done").otherwise("pending").alias("embed_status"))
    settled = t.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "error").otherwise("skipped").alias("status"))
    return merge.settle(items, settled, "embed_status")


def mojibake_decode(spark, d):
    """Texts whose UTF-8 bytes were read as Latin-1, put right again."""
    docs = t.table(spark, d, "documents")
    broken = docs.select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("raw"))
    return broken.select("doc_id", F.md5(X.repair_mojibake(F.col("raw"))).alias("text_md5"))


def highlight(spark, d):
    return t.table(spark, d, "benchmark").select("item_id", X.highlight(F.col("text"), "the").alias("marked"))


def group_concat_distinct(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda x: x.cast("string")), "\x1f").alias("suppliers"))


def first_seen_dedup(spark, d):
    e = t.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


QUERIES = {
    "timeline_first_page": _timeline(), "timeline_dated_cursor": _timeline(("2020-06-01T00:00:00.000Z", 100)), "timeline_null_tail": _timeline((None, 700)),
    "timeline_month_groups": lambda s, d: timeline.month_headers(t.items(s, d).select("id", "capture_date")).filter("is_header").select("month", "id"),
    "fts_prefix_and": fts_prefix_and, "fts_phrase": fts_phrase, "fts_count": fts_count, "fts_bm25_topk": _search("the heat", 10),
    "search_filtered": _search("the", 30, 0, lambda i: filters.by_date(filters.by_type(i, ["audio", "photo"]), "2020-03-01", "2021-03-01")),
    "search_page_offset": _search("de", 25, 50), "search_ids": search_ids, "search_snapshot": search_snapshot,
    "source_projection": source_projection, "source_filter": source_filter, "servable_original": servable_original, "item_cards": item_cards,
    "dedup_content_hash": dedup_content_hash, "dedup_null_hash": dedup_null_hash, "merge_search_tokens": merge_search_tokens, "occurrence_idempotent": occurrence_idempotent,
    "asset_upsert": asset_upsert, "source_upsert": source_upsert, "undo_source": undo_source, "orphan_blobs": orphan_blobs, "import_summary": import_summary,
    "favourite_overrides": favourite_overrides, "transcript_save": transcript_save, "status_settle": status_settle, "mojibake_decode": mojibake_decode,
    "highlight": highlight, "group_concat_distinct": group_concat_distinct, "first_seen_dedup": first_seen_dedup,
}

_MERGED = "(SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p) WHERE w <> '' GROUP BY w))"

ORACLE_SQL = {
    "timeline_first_page": _timeline_sql(""),
    "timeline_dated_cursor": _timeline_sql("WHERE capture_date < '2020-06-01T00:00:00.000Z' OR (capture_date = '2020-06-01T00:00:00.000Z' AND id < 100) OR capture_date IS NULL"),
    "timeline_null_tail": _timeline_sql("WHERE capture_date IS NULL AND id < 700"),
    "timeline_month_groups": f"""WITH {t.ITEMS}, m AS (SELECT id, capture_date, CASE WHEN capture_date IS NULL THEN 'undated' ELSE substring(capture_date, 1, 4) || '-' || (substring(capture_date, 6, 2)::INT - 1) END AS month FROM items),
      l AS (SELECT *, lag(month) OVER (ORDER BY {_ORDER}) AS before FROM m) SELECT month, id FROM l WHERE before IS DISTINCT FROM month""",
    "fts_prefix_and": f"WITH {t.ITEMS}, {_TOK} SELECT * FROM (SELECT id, count(*) FILTER (starts_with(t, 'the')) AS f0, count(*) FILTER (starts_with(t, 'and')) AS f1, count(*) FILTER (starts_with(t, 're')) AS f2 FROM tok GROUP BY id) WHERE f0 > 0 AND f1 > 0 AND f2 > 0",
    "fts_phrase": f"WITH {t.ITEMS}, {_TOK}, n AS (SELECT id, t, lead(t) OVER (PARTITION BY id, col ORDER BY p) AS u FROM tok) SELECT id, count(*) AS f0 FROM n WHERE t = 'of' AND starts_with(u, 'th') GROUP BY id",
    "fts_count": f"WITH {t.ITEMS}, {_TOK} SELECT count(*) AS n FROM (SELECT id FROM tok GROUP BY id HAVING count(*) FILTER (starts_with(t, 'the')) > 0 AND count(*) FILTER (starts_with(t, 'and')) > 0)",
    "fts_bm25_topk": _search_sql(["the", "heat"], "", 10),
    "search_filtered": _search_sql(["the"], "WHERE media_type IN ('audio', 'photo') AND capture_date >= '2020-03-01' AND capture_date <= '2021-03-01T23:59:59.999Z'", 30),
    "search_page_offset": _search_sql(["de"], "", 25, 50),
    "search_ids": _bm25(["und"]) + f" SELECT id FROM found ORDER BY rank, {_ORDER} LIMIT 100",
    "search_snapshot": _bm25(["with"]) + f", p AS (SELECT *, CAST(row_number() OVER (ORDER BY rank, {_ORDER}) - 1 AS INT) AS pos FROM found) SELECT 32 AS token_length, pos, id, media_type FROM p WHERE pos BETWEEN 20 AND 39",
    "source_projection": f"WITH {t.ITEMS}, {t.OCCURRENCES}, {t.SOURCES} SELECT i.id, (SELECT s.type FROM occurrences o JOIN sources s ON s.id = o.source_id WHERE o.item_id = i.id ORDER BY o.created_at, o.id LIMIT 1) AS source FROM items i",
    "source_filter": f"WITH {t.ITEMS}, {t.OCCURRENCES}, {t.SOURCES} SELECT id FROM items i WHERE EXISTS (SELECT 1 FROM occurrences o JOIN sources s ON s.id = o.source_id WHERE o.item_id = i.id AND s.type = 'linkedin')",
    "servable_original": f"WITH {t.OCCURRENCES} SELECT item_id, stored_path FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY storage_mode <> 'in_place', created_at, id) AS r FROM occurrences) WHERE r = 1",
    "item_cards": f"WITH {t.ITEMS} SELECT id, media_type, CAST(length(title) AS INT) AS title_chars, md5(substring(description, 1, 4096)) AS description_md5, id % 3 = 0 AS has_thumbnail FROM items",
    "dedup_content_hash": f"""WITH {t.ITEMS}, g AS (SELECT content_hash, min(id) AS id, arg_min(media_type, id) AS media_type, arg_min(capture_date, id) FILTER (capture_date IS NOT NULL) AS capture_date,
      string_split(string_agg(search_meta, ' ' ORDER BY id), ' ') AS ws FROM items GROUP BY content_hash) SELECT content_hash, id, media_type, capture_date, {_MERGED} AS search_meta FROM g""",
    "dedup_null_hash": f"""WITH {t.ITEMS}, n AS (SELECT id, media_type, capture_date, CASE WHEN id % 2 = 0 THEN content_hash END AS content_hash FROM items)
      SELECT content_hash, id, media_type, capture_date FROM n WHERE content_hash IS NULL UNION ALL
      SELECT content_hash, min(id), arg_min(media_type, id), arg_min(capture_date, id) FILTER (capture_date IS NOT NULL) FROM n WHERE content_hash IS NOT NULL GROUP BY content_hash""",
    "merge_search_tokens": f"WITH g AS (SELECT conv_id, regexp_split_to_array(string_agg(text, ' ' ORDER BY turn, text), '\\s+') AS ws FROM conversations GROUP BY conv_id), m AS (SELECT conv_id, {_MERGED} AS tokens FROM g) SELECT conv_id, CAST(len(string_split(tokens, ' ')) AS INT) AS n, md5(tokens) AS tokens_md5 FROM m",
    "occurrence_idempotent": f"WITH {t.OCCURRENCES} SELECT item_id, source_id, id % 5 AS source_ref, CASE WHEN bool_or(id % 4 = 0) THEN 'old' ELSE 'new' END AS origin FROM occurrences GROUP BY ALL",
    "asset_upsert": """SELECT l_partkey AS item_id, 'thumb' AS kind, arg_max('t/' || l_orderkey, l_orderkey * 10 + l_linenumber) AS path,
      arg_max(l_linenumber, l_orderkey * 10 + l_linenumber) FILTER (l_linenumber % 3 <> 0) AS width FROM lineitem GROUP BY l_partkey""",
    "source_upsert": "SELECT o_custkey AS source_key, arg_max(o_orderpriority, o_orderkey) AS label, arg_max(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS original_path FROM orders GROUP BY o_custkey",
    "undo_source": f"""WITH {t.ITEMS}, {t.OCCURRENCES}, kept AS (SELECT * FROM items WHERE id IN (SELECT item_id FROM occurrences WHERE source_id <> 'src3'))
      SELECT 'item' AS what, CAST(id AS VARCHAR) AS key FROM kept UNION ALL SELECT DISTINCT 'blob', content_hash FROM items WHERE content_hash NOT IN (SELECT content_hash FROM kept)
      UNION ALL SELECT 'occurrence', CAST(id AS VARCHAR) FROM occurrences WHERE source_id <> 'src3'""",
    "orphan_blobs": f"""WITH {t.ITEMS}, {t.OCCURRENCES} SELECT DISTINCT content_hash, 'originals/' || substring(content_hash, 1, 2) || '/' || content_hash || '.txt' AS path FROM items
      WHERE content_hash NOT IN (SELECT i.content_hash FROM occurrences o JOIN items i ON i.id = o.item_id WHERE storage_mode = 'content_addressed')""",
    "import_summary": f"WITH {t.OCCURRENCES} SELECT source_id, count(*) AS records, count(DISTINCT item_id) AS items_touched, CAST(sum((storage_mode = 'content_addressed')::INT) AS BIGINT) AS retained FROM occurrences GROUP BY source_id",
    "favourite_overrides": f"WITH {t.ITEMS} SELECT i.id, CASE WHEN l.doc_id IS NULL THEN i.id % 4 = 0 ELSE l.quality = 1 END AS is_favourite FROM items i LEFT JOIN labels l ON l.doc_id = i.id",
    "transcript_save": f"""WITH {t.ITEMS}, j AS (SELECT i.id, search_meta, CASE WHEN i.id % 6 = 0 THEN 'done' ELSE 'pending' END AS s, c.text, regexp_split_to_array(search_meta || ' ' || coalesce(c.text, ''), '\\s+') AS ws
      FROM items i LEFT JOIN conversations c ON c.conv_id = i.id AND c.turn = 0)
      SELECT id, md5(CASE WHEN text IS NOT NULL AND s <> 'done' THEN {_MERGED} ELSE search_meta END) AS meta_md5, CASE WHEN text IS NOT NULL THEN 'done' ELSE s END AS transcript_status FROM j""",
    "status_settle": f"WITH {t.ITEMS} SELECT i.id, CASE WHEN i.id % 5 = 0 THEN 'done' WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'error' ELSE 'skipped' END AS embed_status FROM items i LEFT JOIN labels l ON l.doc_id = i.id",
    "mojibake_decode": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "highlight": "SELECT item_id, regexp_replace(text, '(the)', '[\\1]', 'gi') AS marked FROM benchmark",
    "group_concat_distinct": "SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, chr(31) ORDER BY lpad(l_suppkey::VARCHAR, 20, '0')) AS suppliers FROM lineitem GROUP BY l_orderkey",
    "first_seen_dedup": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
}
