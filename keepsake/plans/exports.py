"""Exports of social networks, phones and photo services, made from the given tables and read as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.plans import tables as t
from keepsake.sources import archives, linkedin, social

#: Documents in a file of posts.
PER_FILE = 50


def _none():
    return F.lit(None).cast("string")


def _at(column="date.value"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _in_order(key, value):
    return F.transform(F.sort_array(F.collect_list(F.struct(key, value.alias("v")))), lambda x: x["v"])


def facebook_posts(s, d):
    """Documents as posts, some with a picture that is there, some with one that is missing."""
    k = F.col("doc_id")
    docs = t.table(s, d, "documents").select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("raw"))
    medium = F.struct(F.struct(F.concat(F.lit("photos/p"), k.cast("string"), F.lit(".jpg")).alias("uri")).alias("media"))
    post = F.struct((F.lit(1_600_000_000) + k).cast("string").alias("timestamp"), F.when(k % 5 != 4, F.array(F.struct(F.col("raw").alias("post")))).alias("data"),
                    F.when(k % 3 == 0, F.array(F.struct(F.array(medium).alias("data")))).alias("attachments"))
    files = docs.groupBy(F.floor(k / PER_FILE).alias("block")).agg(F.to_json(_in_order("doc_id", post)).alias("text")).select(F.concat(F.lit("fb/"), F.col("block").cast("string")).alias("file"), "text")
    there = docs.filter(k % 6 == 0).select(F.concat(F.lit("export/photos/p"), k.cast("string"), F.lit(".jpg")).alias("path"))
    kept, skipped = social.facebook_posts(files, there)
    return kept.select(F.col("sourceRef").alias("ref"), F.col("mediaType").alias("kind"), F.col("originalPath").alias("path"), F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"), _at().alias("at")).union(
        skipped.select("ref", "reason", _none(), _none(), _none()))


def thread_buckets(s, d):
    """Conversations as threads in four folders of messages, of which each service reads its own."""
    c = t.table(s, d, "conversations")
    message = F.struct(F.col("role").alias("sender_name"), (F.lit(1_600_000_000_000) + F.col("turn") * 1000).alias("timestamp_ms"), F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("content"))
    bucket = F.element_at(F.array(*map(F.lit, ("inbox", "archived_threads", "filtered_threads", "message_requests"))), (F.col("conv_id") % 4 + 1).cast("int"))
    files = c.groupBy("conv_id").agg(_in_order("turn", message).alias("messages")).select(
        F.concat(F.lit("x/messages/"), bucket, F.lit("/t"), F.col("conv_id").cast("string"), F.lit("/message_1.json")).alias("file"), F.to_json(F.struct("messages")).alias("text"))
    rows = social.messenger(files)[0].unionByName(social.instagram(files)[0])
    return rows.select(F.col("sourceType").alias("service"), F.col("sourceRef").alias("ref"), "author", F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"))


def linkedin_messages(s, d):
    """Conversations as message tables, a file each, texts quoted."""
    c = t.table(s, d, "conversations")
    row = F.concat("role", F.lit(',"Else, Someone",2021-03-04 10:20:30 UTC,"'), F.regexp_replace(F.coalesce("text", F.lit("")), '"', '""'), F.lit('"'))
    files = c.groupBy("conv_id").agg(F.array_join(_in_order("turn", row), "\n").alias("rows")).select(
        F.concat(F.lit("li/"), F.col("conv_id").cast("string"), F.lit("/messages.csv")).alias("file"), F.concat(F.lit("FROM,TO,DATE,CONTENT\n"), "rows").alias("text"))
    kept, skipped = linkedin.read(files)
    meta = lambda name: F.get_json_object("sourceMeta", f"$.{name}")
    return kept.select(F.col("sourceRef").alias("ref"), "author", F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"), _at().alias("at"), meta("kind").alias("kind"), meta("to").alias("to")).union(
        skipped.select("ref", "reason", _none(), _none(), "code", _none()))


def apple_messages(s, d):
    """Conversations as the tables of a message database, with attachments, unsafe paths and empty messages."""
    turn = F.col("turn")
    c = t.table(s, d, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") * 1000 + turn).cast("long").alias("ROWID"))
    message = c.select("ROWID", F.concat(F.lit("g"), F.col("ROWID").cast("string")).alias("guid"), F.when(turn % 5 != 4, F.col("text")).alias("text"), (turn % 2 + 1).cast("long").alias("handle_id"),
                       (F.col("role") == "user").cast("int").alias("is_from_me"), (F.lit(50_000_000) + turn * 60).cast("long").alias("date"), F.lit("SMS").alias("service"))
    handle = c.select((turn % 2 + 1).cast("long").alias("ROWID")).distinct().withColumn("id", F.concat(F.lit("h"), F.col("ROWID").cast("string")))
    chat = c.select(F.col("conv_id").cast("long").alias("ROWID")).distinct().select("ROWID", F.concat(F.lit("c"), F.col("ROWID").cast("string")).alias("guid"), F.concat(F.lit("chat "), F.col("ROWID").cast("string")).alias("display_name"))
    with_file = c.filter(turn % 4 == 3)
    name = F.when(turn % 8 == 7, F.lit("../../etc/x.jpg")).otherwise(F.concat(F.lit("~/Library/Messages/Attachments/aa/p"), F.col("ROWID").cast("string"), F.lit(".jpg")))
    kept, skipped = archives.imessage(message, handle, chat, c.select(F.col("conv_id").cast("long").alias("chat_id"), F.col("ROWID").alias("message_id")),
                                      with_file.select("ROWID", name.alias("filename"), F.lit("image/jpeg").alias("mime_type"), F.lit("pic.jpg").alias("transfer_name")),
                                      with_file.select(F.col("ROWID").alias("message_id"), F.col("ROWID").alias("attachment_id")))
    return kept.select(F.col("sourceRef").alias("ref"), F.col("mediaType").alias("kind"), "author", F.col("originalPath").alias("path"), _at().alias("at"), F.get_json_object("sourceMeta", "$.chatName").alias("chat")).union(
        skipped.select("ref", "code", _none(), _none(), _none(), _none()))


def photo_records(s, d):
    """Parts as pictures, most of them with a sidecar that dates, places and describes them."""
    k = F.col("p_partkey")
    p = t.table(s, d, "part").select("p_partkey", "p_name", F.concat(F.lit("d"), (k % 50).cast("string")).alias("dir"), F.concat(F.lit("img"), k.cast("string"), F.lit(".jpg")).alias("name"))
    nowhere = k % 7 == 0
    text = F.to_json(F.struct(F.struct((F.lit(1_500_000_000) + k).cast("string").alias("timestamp")).alias("photoTakenTime"), F.when(k % 3 != 0, F.col("p_name")).otherwise("").alias("description"),
                              F.struct(F.when(nowhere, 0.0).otherwise(k % 90 + 0.5).alias("latitude"), F.when(nowhere, 0.0).otherwise(k % 180 + 0.25).alias("longitude"), F.lit(0.0).alias("altitude")).alias("geoData")))
    kept = archives.photos(p.select("dir", "name", F.timestamp_seconds(F.lit(1_577_836_800)).alias("modified")), p.filter("p_partkey % 4 <> 0").select("dir", F.concat("name", F.lit(".json")).alias("json"), text.alias("text")))
    return kept.select(F.col("sourceRef").alias("ref"), _at().alias("at"), F.col("date.source").alias("dated_by"), "gps.lat", "gps.lon", "body")


def folder_records(s, d):
    """Orders as files of four kinds, one of them unknown; some carry a date and place of their own."""
    k = F.col("o_orderkey")
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".opus", ".pdf", ".xyz"))), (k % 4 + 1).cast("int"))
    files = t.table(s, d, "orders").select("o_orderkey", F.concat(F.lit("/r/x/f"), k.cast("string"), ext).alias("path"), F.col("o_orderdate").cast("timestamp").alias("modified"), F.lit(1).alias("length"))
    exif = files.filter(k % 8 == 0).select("path", F.timestamp_seconds(F.lit(1_557_050_400)).alias("taken"), F.when(k % 16 == 0, 0.0).otherwise(10.0).alias("lat"), F.when(k % 16 == 0, 0.0).otherwise(20.0).alias("lon"))
    kept, _ = archives.folder(files.drop("o_orderkey"), "/r", exif)
    return kept.select(F.col("sourceRef").alias("ref"), F.col("mediaType").alias("kind"), _at().alias("at"), F.col("date.source").alias("dated_by"), "gps.lat")


QUERIES = {f.__name__: f for f in (facebook_posts, thread_buckets, linkedin_messages, apple_messages, photo_records, folder_records)}

_F = "'%Y-%m-%d %H:%M:%S'"

ORACLE_SQL = {
    "facebook_posts": f"""WITH f AS (SELECT doc_id AS k, 'fb/' || (doc_id // {PER_FILE}) || '#' || (row_number() OVER (PARTITION BY doc_id // {PER_FILE} ORDER BY doc_id) - 1) AS r, nullif(CASE WHEN doc_id % 5 <> 4 THEN text END, '') AS body,
        strftime(make_timestamp((1600000000 + doc_id)::BIGINT * 1000000), {_F}) AS "at" FROM documents)
      SELECT r || ':media:0' AS ref, 'photo' AS kind, 'export/photos/p' || k || '.jpg' AS path, md5('') AS body_md5, "at" FROM f WHERE k % 6 = 0
      UNION ALL SELECT r || ':text', 'message', NULL, md5(coalesce(body, '')), "at" FROM f WHERE body IS NOT NULL OR k % 6 <> 0
      UNION ALL SELECT r || ':media:0', 'media is missing', NULL, NULL, NULL FROM f WHERE k % 6 = 3""",
    "thread_buckets": """WITH m AS (SELECT *, ['inbox', 'archived_threads', 'filtered_threads', 'message_requests'][(conv_id % 4 + 1)::INT] AS bucket, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
      r AS (SELECT conv_id, 'x/messages/' || bucket || '/t' || conv_id || '/message_1.json#' || i || ':text' AS ref, role AS author, md5(coalesce(trim(text, ' '), '')) AS body_md5 FROM m)
      SELECT 'messenger' AS service, ref, author, body_md5 FROM r WHERE conv_id % 4 < 3 UNION ALL SELECT 'instagram', ref, author, body_md5 FROM r WHERE conv_id % 4 = 0""",
    "linkedin_messages": """SELECT 'messages.csv#' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ref, role AS author, md5(coalesce(trim(text, ' '), '')) AS body_md5, '2021-03-04 10:20:30' AS at, 'message' AS kind, 'Else, Someone' AS "to" FROM conversations""",
    "apple_messages": f"""WITH m AS (SELECT 'message:' || (conv_id * 1000 + turn) AS r, conv_id * 1000 + turn AS k, turn, CASE WHEN turn % 5 <> 4 THEN text END AS text, CASE WHEN role = 'user' THEN 'Me' ELSE 'h' || (turn % 2 + 1) END AS author,
        strftime(TIMESTAMP '2001-01-01' + to_seconds(50000000 + turn * 60), {_F}) AS "at", 'chat ' || conv_id AS chat FROM conversations)
      SELECT r AS ref, 'message' AS kind, author, NULL AS path, "at", chat FROM m WHERE text IS NOT NULL
      UNION ALL SELECT r || ':attachment:' || k, 'photo', author, 'aa/p' || k || '.jpg', "at", chat FROM m WHERE turn % 8 = 3
      UNION ALL SELECT r || ':attachment:' || k, 'E_ATTACHMENT_PATH', NULL, NULL, NULL, NULL FROM m WHERE turn % 8 = 7
      UNION ALL SELECT r, 'E_EMPTY_MESSAGE', NULL, NULL, NULL, NULL FROM m WHERE text IS NULL AND turn % 4 <> 3""",
    "photo_records": f"""SELECT 'd' || (p_partkey % 50) || '/img' || p_partkey || '.jpg' AS ref, CASE WHEN p_partkey % 4 <> 0 THEN strftime(make_timestamp((1500000000 + p_partkey)::BIGINT * 1000000), {_F}) ELSE '2020-01-01 00:00:00' END AS at,
      CASE WHEN p_partkey % 4 <> 0 THEN 'sidecar' ELSE 'mtime' END AS dated_by, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 THEN p_partkey % 90 + 0.5::DOUBLE END AS lat,
      CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 THEN p_partkey % 180 + 0.25::DOUBLE END AS lon, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN p_name END AS body FROM part""",
    "folder_records": f"""SELECT 'x/f' || o_orderkey || ['.jpg', '.opus', '.pdf'][(o_orderkey % 4 + 1)::INT] AS ref, ['photo', 'audio', 'document'][(o_orderkey % 4 + 1)::INT] AS kind,
      CASE WHEN o_orderkey % 8 = 0 THEN '2019-05-05 10:00:00' ELSE strftime(o_orderdate, {_F}) END AS at, CASE WHEN o_orderkey % 8 = 0 THEN 'exif' ELSE 'mtime' END AS dated_by, CASE WHEN o_orderkey % 16 = 8 THEN 10.0::DOUBLE END AS lat FROM orders WHERE o_orderkey % 4 < 3""",
}
