"""Projections, lookups and scalars of the catalog over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.operators import filters, speech
from keepsake.plans import tables as t
from keepsake.sources import chatlog, guards, probes


def item_projection(s, d):
    """All columns of an item; those that the table lacks are null."""
    view = filters.item_view(t.items(s, d).withColumn("is_favourite", F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0)))
    return view.select("id", "media_type", F.md5("title").alias("title_md5"), "capture_date", "content_hash", "is_favourite", F.col("gps_lat").isNull().alias("no_place"), F.lit(len(view.columns)).alias("columns"))


def category_lookup(s, d):
    """Customers as categories of their nation's key: the one of a key, and the one of an id."""
    cats = t.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("n"), "c_nationkey")).alias("source_key"))
    return filters.category_by_source_key(cats, "n7").unionByName(filters.category_by_id(cats, 8)).select("id", "name", "source_key")


def ingest_tally(s, d):
    """An import's counts by source, with documents of label 0 as what was skipped."""
    lost = t.table(s, d, "labels").filter("quality = 0").join(t.table(s, d, "documents").select("doc_id", F.col("source").alias("source_id")), "doc_id").select("source_id")
    return filters.ingestion_summary(t.occurrences(s, d), lost)


def merge_tokens_sql(s, d):
    """Token unions by the function that is registered for SQL."""
    X.register(s)
    rows = t.table(s, d, "part").select("p_partkey", F.concat_ws("  ", "p_name", "p_brand", "p_name").alias("existing"), F.when(F.col("p_partkey") % 5 != 0, F.concat_ws("\t", "p_type", "p_brand")).alias("incoming"))
    return rows.selectExpr("p_partkey", "merge_tokens(existing, incoming) AS tokens")


def text_scalars(s, d):
    """Search tokens, bounds, safe segments, chat names and time limits."""
    o = t.table(s, d, "orders")
    path = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("a/b/"), "o_orderstatus", F.lit(":"), "o_orderkey", F.lit(".jpg")))
    chat = F.concat(F.lit("x/WhatsApp Chat with "), "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, ".txt").otherwise(".zip"))
    return o.select("o_orderkey", X.search_tokens(path, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("tokens"), X.bounded(F.col("o_orderpriority"), 4).alias("bounded"),
                    X.safe_segment(F.concat(F.lit(".."), "o_orderstatus", F.lit("/"), "o_orderpriority", F.lit(".."))).alias("segment"), chatlog.chat_name(chat).alias("chat"),
                    speech.timeout_ms(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 100)).alias("timeout"))


def export_guards(s, d):
    """Pages as the entries of an export each host: those below more than three folders are refused, of the others a host's first 50,000 stay."""
    url = F.regexp_replace("url", "^[a-z]+://", "")
    pages = t.table(s, d, "pages").filter("url is not null").select(F.substring_index(url, "/", 1).alias("export"), F.concat_ws("/", url, F.when(F.col("page_id") % 3 == 0, "more"), "page_id").alias("path"))
    kept, skipped = guards.bounded_entries(pages, folders=3)
    return kept.select("path", F.lit("").alias("code")).unionByName(skipped.select(F.col("ref").alias("path"), "code"))


def real_time_factors(s, d):
    """Parts as clips: their size as seconds, their price as the milliseconds that recognition took."""
    rows = t.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("double")).otherwise(0.0).alias("seconds"), F.col("p_retailprice").cast("double").alias("ms"))
    return probes.real_time_factor(rows.select("id", "seconds"), rows.select("id", "ms")).select("id", F.round("rtf", 6).alias("rtf"))


QUERIES = {f.__name__: f for f in (item_projection, category_lookup, ingest_tally, merge_tokens_sql, text_scalars, export_guards, real_time_factors)}

_UNION = "(SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p) WHERE w <> '' GROUP BY w))"

ORACLE_SQL = {
    "item_projection": f"""WITH {t.ITEMS} SELECT id, media_type, md5(title) AS title_md5, capture_date, content_hash, coalesce(CASE WHEN id % 3 = 0 THEN id % 2 = 0 END, false) AS is_favourite, true AS no_place, 19::INT AS columns FROM items""",
    "category_lookup": """SELECT * FROM (SELECT c_custkey AS id, c_name AS name, 'n' || c_nationkey AS source_key FROM customer WHERE c_custkey % 4 <> 0 AND c_nationkey = 7 ORDER BY id LIMIT 1)
      UNION ALL SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 0 THEN 'n' || c_nationkey END FROM customer WHERE c_custkey = 8""",
    "ingest_tally": f"""WITH {t.OCCURRENCES}, o AS (SELECT source_id, count(*) AS records, count(DISTINCT item_id) AS items_touched, count(*) FILTER (storage_mode = 'content_addressed') AS retained,
        count(*) FILTER (storage_mode = 'in_place') AS in_place FROM occurrences GROUP BY source_id), l AS (SELECT source AS source_id, count(*) AS skipped FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY source)
      SELECT coalesce(o.source_id, l.source_id) AS source_id, coalesce(records, 0) AS records, coalesce(items_touched, 0) AS items_touched, coalesce(retained, 0) AS retained, coalesce(in_place, 0) AS in_place, coalesce(skipped, 0) AS skipped
      FROM o FULL JOIN l ON l.source_id = o.source_id""",
    "merge_tokens_sql": rf"""WITH p AS (SELECT p_partkey, string_split_regex(concat_ws(' ', p_name, p_brand, p_name, CASE WHEN p_partkey % 5 <> 0 THEN concat_ws(' ', p_type, p_brand) END), '\s+') AS ws FROM part) SELECT p_partkey, {_UNION} AS tokens FROM p""",
    "text_scalars": r"""SELECT o_orderkey, nullif(concat_ws(' ', CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus || ':' || o_orderkey || '.jpg' END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END), '') AS tokens,
      substring(o_orderpriority, 1, 4) AS bounded, o_orderstatus || '_' || o_orderpriority AS segment, o_orderpriority AS chat,
      CASE WHEN o_orderkey % 7 = 0 THEN 7200000 ELSE least(7200000, greatest(120000, trunc(o_totalprice / 100::DOUBLE * 10000))) END::BIGINT AS timeout FROM orders""",
    "export_guards": r"""SELECT path, CASE WHEN len(path) - len(replace(path, '/', '')) > 3 THEN 'E_DIR_TOO_DEEP' ELSE '' END AS code
      FROM (SELECT concat_ws('/', regexp_replace(url, '^[a-z]+://', ''), CASE WHEN page_id % 3 = 0 THEN 'more' END, page_id::VARCHAR) AS path FROM pages WHERE url IS NOT NULL)""",
    "real_time_factors": "SELECT p_partkey AS id, round(p_retailprice::DOUBLE / 1000 / CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END, 6) AS rtf FROM part",
}
