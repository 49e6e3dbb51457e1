"""The given tables as catalog tables, in Spark and in SQL.

Documents are items, their sources (taken twice for some) occurrences, labels assignments; coordinates, which
the tables lack, are arithmetic of document ids. Dates are ISO text, as in the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 7919 % 700).cast("int")).cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.element_at(F.array(*map(F.lit, ("photo", "video", "audio", "message", "document"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("media_type"),
        F.substring("text", 1, 60).alias("title"), F.col("text").alias("description"), F.concat_ws(" ", "source", "lang").alias("search_meta"),
        F.when(F.col("doc_id") % 17 != 0, F.concat(day, F.lit("T00:00:00.000Z"))).alias("capture_date"), F.sha2("text", 256).alias("content_hash"))


ITEMS = """items AS (SELECT doc_id AS id, ['photo', 'video', 'audio', 'message', 'document'][(doc_id % 5 + 1)::INT] AS media_type,
  substring(text, 1, 60) AS title, text AS description, concat_ws(' ', source, lang) AS search_meta,
  CASE WHEN doc_id % 17 <> 0 THEN CAST(DATE '2020-01-01' + (doc_id * 7919 % 700)::INT AS VARCHAR) || 'T00:00:00.000Z' END AS capture_date,
  sha256(text) AS content_hash FROM documents)"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, item_id, source_id, created_at, storage_mode, stored_path): one of each document's source, and for every third one of another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = docs.select((F.col("doc_id") * 2).alias("id"), F.col("doc_id").alias("item_id"), F.col("source").alias("source_id"), (F.col("doc_id") * 31 % 97).alias("created_at"),
                        F.when(F.col("doc_id") % 4 == 0, "in_place").otherwise("content_addressed").alias("storage_mode"))
    second = docs.filter(F.col("doc_id") % 3 == 0).select((F.col("doc_id") * 2 + 1).alias("id"), F.col("doc_id").alias("item_id"), F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("source_id"),
                                                          (F.col("doc_id") * 17 % 89).alias("created_at"), F.lit("content_addressed").alias("storage_mode"))
    return first.unionByName(second).withColumn("stored_path", F.concat(F.lit("p/"), F.col("id").cast("string")))


OCCURRENCES = """occurrences AS (SELECT *, 'p/' || id AS stored_path FROM (
  SELECT doc_id * 2 AS id, doc_id AS item_id, source AS source_id, doc_id * 31 % 97 AS created_at, CASE WHEN doc_id % 4 = 0 THEN 'in_place' ELSE 'content_addressed' END AS storage_mode FROM documents
  UNION ALL SELECT doc_id * 2 + 1, doc_id, 'src' || (doc_id % 7), doc_id * 17 % 89, 'content_addressed' FROM documents WHERE doc_id % 3 = 0))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type): the distinct sources, of three kinds."""
    ids = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct()
    return ids.withColumn("type", F.element_at(F.array(F.lit("whatsapp"), F.lit("linkedin"), F.lit("folder")), F.length("id") - 2 - F.when(F.col("id").rlike("[02468]$"), 1).otherwise(0)))


SOURCES = """sources AS (SELECT id, ['whatsapp', 'linkedin', 'folder'][length(id) - 2 - CASE WHEN regexp_matches(id, '[02468]$') THEN 1 ELSE 0 END] AS type
  FROM (SELECT DISTINCT source AS id FROM documents))"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name): one for each remainder of document ids by 40."""
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("id")).distinct()
    kind = F.element_at(F.array(*map(F.lit, ("place", "theme", "person", "custom"))), (F.col("id") % 4 + 1).cast("int"))
    return ids.select("id", kind.alias("kind"), F.concat(F.when(F.col("id") % 2 == 0, "Group ").otherwise("group "), (F.col("id") % 10).cast("string")).alias("name"))


CATEGORIES = """categories AS (SELECT id, ['place', 'theme', 'person', 'custom'][(id % 4 + 1)::INT] AS kind,
  CASE WHEN id % 2 = 0 THEN 'Group ' ELSE 'group ' END || (id % 10) AS name FROM (SELECT DISTINCT doc_id % 40 AS id FROM documents))"""


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, category_id, source, state): automatic ones for all documents, users' for labelled ones, some of them removals."""
    auto = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 40).alias("category_id"), F.lit("auto").alias("source"), F.lit("assigned").alias("state"))
    user = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), ((F.col("doc_id") + F.col("toxic")) % 40).alias("category_id"), F.lit("user").alias("source"),
                                                 F.when(F.col("quality") == 0, "removed").otherwise("assigned").alias("state"))
    return auto.unionByName(user)


ASSIGNMENTS = """assignments AS (SELECT doc_id AS item_id, doc_id % 40 AS category_id, 'auto' AS source, 'assigned' AS state FROM documents
  UNION ALL SELECT doc_id, (doc_id + toxic) % 40, 'user', CASE WHEN quality = 0 THEN 'removed' ELSE 'assigned' END FROM labels),
effective AS (SELECT item_id, category_id, source, state FROM (SELECT *, row_number() OVER (PARTITION BY item_id, category_id ORDER BY (source = 'user') DESC) AS r FROM assignments) WHERE r = 1),
members AS (SELECT item_id, category_id FROM effective WHERE state = 'assigned')"""


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, cover_item_id, origin, category_id): users' own, accepted and dismissed suggestions, from nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    origin = F.element_at(F.array(*map(F.lit, ("user", "suggested", "dismissed"))), (F.col("k") % 3 + 1).cast("int"))
    return n.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("id"), F.when(F.col("k") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"),
                    F.col("k").alias("cover_item_id"), origin.alias("origin"), F.when(F.col("k") % 3 != 0, F.col("k")).alias("category_id"))


COLLECTIONS = """collections AS (SELECT 'c' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, CAST(n_nationkey AS BIGINT) AS cover_item_id,
  ['user', 'suggested', 'dismissed'][n_nationkey % 3 + 1] AS origin, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS BIGINT) END AS category_id FROM nation)"""


def collection_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collection_id, item_id, position, added_at): documents dealt to the first twenty nations."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(F.concat(F.lit("c"), (F.col("doc_id") % 20).cast("string")).alias("collection_id"), F.col("doc_id").alias("item_id"),
                    F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") * 13 % 101).alias("position"), (F.col("doc_id") * 7 % 50).alias("added_at"))


COLLECTION_ITEMS = """collection_items AS (SELECT 'c' || (doc_id % 20) AS collection_id, doc_id AS item_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 13 % 101 END AS position, doc_id * 7 % 50 AS added_at FROM documents)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lat, lon): half of the documents gather around grid corners, the others lie apart."""
    d = F.col("doc_id").cast("double")
    k = F.col("doc_id")
    near = k % 2 == 0
    lat = F.when(near, (k % 12) * 5.0 - 30 + (k * 37 % 11) * 0.004).otherwise(d * 0.7548776662 % 1 * 140 - 70)
    lon = F.when(near, (k % 12) * 20.0 - 120 + (k * 53 % 13) * 0.004).otherwise(d * 0.5698402910 % 1 * 360 - 180)
    return table(spark, sf_dir, "documents").select(k.alias("id"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


POINTS = """points AS (SELECT doc_id AS id,
  round(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 12) * 5.0::DOUBLE - 30 + (doc_id * 37 % 11) * 0.004::DOUBLE ELSE doc_id::DOUBLE * 0.7548776662::DOUBLE % 1 * 140 - 70 END, 6) AS lat,
  round(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 12) * 20.0::DOUBLE - 120 + (doc_id * 53 % 13) * 0.004::DOUBLE ELSE doc_id::DOUBLE * 0.5698402910::DOUBLE % 1 * 360 - 180 END, 6) AS lon FROM documents)"""


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, lat, lon, admin1, country): suppliers, spread over the globe."""
    k = F.col("s_suppkey").cast("double")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.round(k * 0.3819660113 % 1 * 120 - 60, 6).alias("lat"),
                                                   F.round(k * 0.7320508076 % 1 * 360 - 180, 6).alias("lon"), F.lit("").alias("admin1"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("country"))


GAZETTEER = """gazetteer AS (SELECT s_suppkey AS id, s_name AS name, round(s_suppkey::DOUBLE * 0.3819660113::DOUBLE % 1 * 120 - 60, 6) AS lat,
  round(s_suppkey::DOUBLE * 0.7320508076::DOUBLE % 1 * 360 - 180, 6) AS lon, '' AS admin1, 'N' || s_nationkey AS country FROM supplier)"""

HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
