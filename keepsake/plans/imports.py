"""Importers, transcripts and the event stream, over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.functions import dates, media
from keepsake.functions import text as X
from keepsake.operators import speech
from keepsake.plans import tables as t
from keepsake.sources import archives, chatlog, social
from keepsake.streaming import ingest


def _chat(s, d):
    """Conversations as chat logs: a header line a turn, the turn's text with its line breaks behind it."""
    c = t.table(s, d, "conversations")
    day = (F.col("conv_id") % 28 + 1).cast("string")
    head = F.concat(F.lit("["), day, F.lit("/"), (F.col("turn") % 12 + 1).cast("string"), F.lit("/2021, 10:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00] "), "role", F.lit(": "))
    lines = c.select(F.col("conv_id").cast("string").alias("file"), "turn", F.posexplode(F.split(F.concat(head, F.regexp_replace("text", "\r", "")), "\n")).alias("n", "value"))
    return lines.select("file", (F.col("turn") * 100_000 + F.col("n")).alias("line_no"), "value")


def line_message_assembly(s, d):
    """Lines put together to messages, dated by the votes so far."""
    m = chatlog.messages(_chat(s, d))
    when = dates.chat_date(F.col("date"), F.col("time"), F.col("ampm"), F.col("order"))
    return m.select("file", "index", "author", F.md5("body").alias("body_md5"), "order", F.date_format(when, "yyyy-MM-dd HH:mm").alias("sent"))


def vote_date_order(s, d):
    """The order of day, month and year that the orders of each customer vote for."""
    o = t.table(s, d, "orders").select("o_custkey", F.concat_ws("/", F.dayofmonth("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")).alias("date"))
    v = o.select("o_custkey", *[x.alias(n) for x, n in zip(dates.date_votes(F.col("date")), ("dmy", "mdy", "ymd"), strict=True)])
    g = v.groupBy("o_custkey").agg(*[F.sum(n).alias(n) for n in ("dmy", "mdy", "ymd")])
    return g.withColumn("order", dates.date_order(F.col("dmy"), F.col("mdy"), F.col("ymd")))


def chat_header_forms(s, d):
    """Conversations as chat logs of three forms by turns: brackets with day first, twelve hours with month first, a dash with year first."""
    c = t.table(s, d, "conversations")
    day, month, minute = (F.col("conv_id") % 15 + 13).cast("string"), (F.col("turn") % 12 + 1).cast("string"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    form = F.col("conv_id") % 3
    head = (F.when(form == 0, F.concat(F.lit("["), day, F.lit("/"), month, F.lit("/2021, 10:"), minute, F.lit(":00] ")))
            .when(form == 1, F.concat(month, F.lit("/"), day, F.lit("/21, 10:"), minute, F.lit(" p.m. - "))).otherwise(F.concat(F.lit("2021-"), F.lpad(month, 2, "0"), F.lit("-"), day, F.lit(", 22:"), minute, F.lit(" - "))))
    lines = c.select(F.col("conv_id").cast("string").alias("file"), "turn", F.posexplode(F.split(F.concat(head, F.col("role"), F.lit(": "), F.regexp_replace("text", "\r", "")), "\n")).alias("n", "value"))
    m = chatlog.messages(lines.select("file", (F.col("turn") * 100_000 + F.col("n")).alias("line_no"), "value"))
    when = dates.chat_date(F.col("date"), F.col("time"), F.col("ampm"), F.col("order"))
    return m.select("file", "index", "platform", "author", F.md5("body").alias("body_md5"), "order", F.date_format(when, "yyyy-MM-dd HH:mm").alias("sent"))


def vote_all_orders(s, d):
    """Votes over dates that customers write in three orders."""
    part = [F.date_format("o_orderdate", f) for f in ("d/M/yyyy", "M.d.yyyy", "yyyy-M-d")]
    o = t.table(s, d, "orders").select("o_custkey", F.element_at(F.array(*part), (F.col("o_custkey") % 3 + 1).cast("int")).alias("date"))
    names = ("dmy", "mdy", "ymd")
    g = o.groupBy("o_custkey").agg(*[F.sum(v).alias(n) for v, n in zip(dates.date_votes(F.col("date")), names, strict=True)])
    return g.withColumn("order", dates.date_order(*map(F.col, names)))


def linkedin_dates(s, d):
    """The four forms of dates, made from order dates and read back."""
    o = t.table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    form = F.element_at(F.array(F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "d MMM yyyy"), F.date_format("day", "MMM d, yyyy"), F.date_format("day", "M/d/yyyy"), F.date_format("day", "yyyy-MM-dd' 10:20:30 UTC'")),
                        (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", F.date_format(dates.linkedin_date(form), "yyyy-MM-dd HH:mm:ss").alias("read"))


def apple_dates(s, d):
    """Moments since 2001 in seconds, microseconds and nanoseconds by turns, read back; each number is in its unit's range."""
    seconds = F.lit(100_000) + F.col("event_id") * 86_400 % 90_000_000
    raw = seconds * F.element_at(F.array(F.lit(1), F.lit(10**6), F.lit(10**9)), (F.col("event_id") % 3 + 1).cast("int"))
    return t.table(s, d, "events").select("event_id", F.date_format(dates.apple_date(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


def telegram_records(s, d):
    """Conversations as a Telegram export, one file a conversation, read as records."""
    c = t.table(s, d, "conversations")
    message = F.struct((F.col("turn") % 7).alias("id"), F.when(F.col("turn") % 5 == 4, "service").otherwise("message").alias("type"), (F.lit(1_600_000_000) + F.col("turn") * 60).cast("string").alias("date_unixtime"),
                       F.col("role").alias("from"), F.array(F.struct(F.lit("plain").alias("type"), F.col("text").alias("text"))).alias("text"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])
    files = c.groupBy("conv_id").agg(listed.alias("messages")).select(F.col("conv_id").cast("string").alias("file"), F.to_json(F.struct(F.lit("chat").alias("name"), F.lit("personal_chat").alias("type"), F.col("conv_id").alias("id"), "messages")).alias("text"))
    kept, _ = social.telegram(files)
    return kept.select(F.get_json_object("sourceMeta", "$.chatId").alias("chat"), "sourceRef", "author", F.md5("body").alias("body_md5"), F.date_format("date.value", "yyyy-MM-dd HH:mm:ss").alias("at"))


def thread_records(s, d):
    """Conversations as message threads with Latin-1 read text, read as records."""
    c = t.table(s, d, "conversations")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    message = F.struct(F.col("role").alias("sender_name"), (F.lit(1_600_000_000_000) + F.col("turn") * 1000).alias("timestamp_ms"), F.when(F.col("turn") % 4 != 3, broken).alias("content"))
    files = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("messages"))
    kept, _ = social.threads(files.select(F.concat(F.lit("x/messages/inbox/t"), F.col("conv_id").cast("string"), F.lit("/message_1.json")).alias("file"), F.to_json(F.struct("messages")).alias("text")))
    return kept.select("sourceRef", "author", F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"), F.date_format("date.value", "HH:mm:ss").alias("at"))


def sidecar_match(s, d):
    """Parts as pictures and JSON files beside them, by the three rules."""
    p = t.table(s, d, "part").select(F.concat(F.lit("d"), (F.col("p_partkey") % 50).cast("string")).alias("dir"), F.col("p_partkey").alias("k"))
    key = F.lpad(F.col("k").cast("string"), 7, "0")
    own = p.select("dir", F.when(F.col("k") % 3 == 1, F.concat(F.lit("img"), key, F.lit("(2).jpg"))).otherwise(F.concat(F.lit("img"), key, F.lit(".jpg"))).alias("name"))
    side = p.filter("k % 4 <> 0").select("dir", F.when(F.col("k") % 3 == 0, F.concat(F.lit("img"), key, F.lit(".jpg.json"))).when(F.col("k") % 3 == 1, F.concat(F.lit("img"), key, F.lit(".jpg(2).json"))).otherwise(
        F.concat(F.lit("img"), F.substring(key, 1, 6), F.lit(".json"))).alias("json"))
    return archives.sidecars(own, side.distinct())


def mailbox_messages(s, d):
    """Documents as one mailbox a source: boundaries, escapes, bodies."""
    docs = t.table(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("file"), "doc_id", F.split(F.concat(F.lit("From x\nSubject: s\n\n>From here\n"), F.regexp_replace("text", "(?m)^(>*From )", ">$1")), "\n").alias("l"))
    lines = docs.select("file", F.posexplode("l").alias("n", "value"), "doc_id").select("file", (F.col("doc_id") * 100_000 + F.col("n")).alias("line_no"), "value")
    return archives.mbox_messages(lines).select("file", "index", F.md5("raw").alias("raw_md5"))


def transcript_segments(s, d):
    """Conversations as transcriber's JSON, read back."""
    c = t.table(s, d, "conversations")
    part = F.struct(F.struct((F.col("turn") * 1500).alias("from"), (F.col("turn") * 1500 + 900).alias("to")).alias("offsets"), F.when(F.col("turn") % 6 != 5, F.concat(F.lit(" "), F.col("text"))).otherwise(" ").alias("text"))
    raw = c.groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.lit("en").alias("language")).alias("result"), F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]).alias("transcription"))).alias("raw"))
    parsed = raw.select("conv_id", speech.parse_transcript(F.col("raw")).alias("t"))
    return parsed.select("conv_id", F.size("t.segments").alias("segments"), F.element_at("t.segments", 1).start.alias("first_start"), F.md5("t.text").alias("text_md5"))


def wer(s, d):
    """Each turn against the one before it in its conversation."""
    c = t.table(s, d, "conversations").withColumn("heard", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("heard is not null")
    return speech.word_errors(c.select("conv_id", "turn", F.col("text").alias("reference"), "heard")).select("conv_id", "turn", "words", "substitutions", "deletions", "insertions", F.round("wer", 6).alias("wer"))


def transcription_drain(s, d):
    items = t.items(s, d).select("id", "media_type", F.when(F.col("id") % 7 == 0, "done").otherwise("pending").alias("transcript_status"))
    out = F.element_at(F.array(*map(F.lit, ("ok", "no-speech", "cancelled", "crash"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return speech.drain(items, t.table(s, d, "documents").select(F.col("doc_id").alias("id"), out.alias("outcome")))


def media_kinds(s, d):
    """Parts named like files, by extension."""
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".MP4", ".opus", ".pdf", ".xyz", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = t.table(s, d, "part").select("p_partkey", F.concat(F.lit("a.b/f"), F.col("p_partkey").cast("string"), ext).alias("path"))
    kind, mime = media.classify(F.col("path"))
    kept, _ = media.classify(F.col("path"), source="whatsapp")
    return p.select("p_partkey", kind.alias("media_type"), mime.alias("mime"), kept.alias("kept_as"), media.content_type(F.lit(None).cast("string"), F.col("path")).alias("content_type"))


def safe_paths(s, d):
    raw = F.element_at(F.array(F.concat(F.lit("photos/"), "p_name"), F.concat(F.lit("photos\\sub\\"), "p_name"), F.lit("../etc/x"), F.concat(F.lit("photos/../"), "p_name"), F.concat(F.lit("/abs/"), "p_name"), F.concat(F.lit("C:\\"), "p_name"), F.concat(F.lit("other/"), "p_name")), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.table(s, d, "part").select("p_partkey", media.safe_media_path(raw, ("photos", "video_files")).alias("path"))


def scalar_labels(s, d):
    """Durations, months, coordinates and clamped numbers."""
    o = t.table(s, d, "orders")
    return o.select("o_orderkey", X.duration_label(F.col("o_totalprice") / 100).alias("duration"), X.month_label(F.col("o_orderdate")).alias("month"), X.clamp01(F.col("o_totalprice") / 200000 - 0.2).alias("clamped"), X.iso_utc(F.col("o_orderdate")).alias("iso"))


def event_activity(s, d):
    """The streaming aggregation, over the table of events."""
    return ingest.activity(t.table(s, d, "events"))


QUERIES = {f.__name__: f for f in (line_message_assembly, chat_header_forms, vote_date_order, vote_all_orders, linkedin_dates, apple_dates, telegram_records, thread_records, sidecar_match, mailbox_messages, transcript_segments, wer, transcription_drain,
                                   media_kinds, safe_paths, scalar_labels, event_activity)}

_EXT = "['.jpg', '.MP4', '.opus', '.pdf', '.xyz', ''][p_partkey % 6 + 1]"
_RULED = """n AS (SELECT 'd' || (p_partkey % 50) AS dir, p_partkey AS k, lpad(p_partkey::VARCHAR, 7, '0') AS key FROM part),
  own AS (SELECT dir, 'img' || key || CASE WHEN k % 3 = 1 THEN '(2).jpg' ELSE '.jpg' END AS name FROM n),
  side AS (SELECT DISTINCT dir, CASE WHEN k % 3 = 0 THEN 'img' || key || '.jpg.json' WHEN k % 3 = 1 THEN 'img' || key || '.jpg(2).json' ELSE 'img' || substring(key, 1, 6) || '.json' END AS json FROM n WHERE k % 4 <> 0)"""

#: The whole table of each alignment, a reference word a step; a run of insertions begins at the last cell that none reaches.
_WER = r"""WITH RECURSIVE turns AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS heard FROM conversations),
  w AS (SELECT row_number() OVER () AS id, conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s'']', ' ', 'g'), '\s+'), lambda x: x <> '') AS a,
    list_filter(string_split_regex(regexp_replace(lower(heard), '[^\p{L}\p{N}\s'']', ' ', 'g'), '\s+'), lambda x: x <> '') AS b FROM turns WHERE heard IS NOT NULL),
  cells AS (SELECT 0 AS i, id, j, j AS cost, 0::BIGINT AS subs, 0::BIGINT AS dels FROM (SELECT id, unnest(range(0, len(b) + 1)) AS j FROM w)
    UNION ALL
    SELECT i + 1, id, j, low + j, last_value(CASE WHEN base - j = low THEN bs END IGNORE NULLS) OVER o, last_value(CASE WHEN base - j = low THEN bd END IGNORE NULLS) OVER o FROM (
      SELECT *, min(base - j) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) AS low FROM (
        SELECT i, id, j, CASE WHEN j = 0 OR cost + 1 < before + miss THEN cost + 1 ELSE before + miss END AS base,
          CASE WHEN j = 0 OR cost + 1 < before + miss THEN subs ELSE subs_before + miss END AS bs, CASE WHEN j = 0 OR cost + 1 < before + miss THEN dels + 1 ELSE dels_before END AS bd FROM (
          SELECT c.*, lag(cost) OVER p AS before, lag(subs) OVER p AS subs_before, lag(dels) OVER p AS dels_before, (w.a[c.i + 1] <> w.b[c.j])::BIGINT AS miss
          FROM cells c JOIN w ON w.id = c.id WHERE c.i < len(w.a) WINDOW p AS (PARTITION BY c.id ORDER BY c.j))))
      WINDOW o AS (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING))
  SELECT conv_id, turn, len(a)::INT AS words, subs::INT AS substitutions, dels::INT AS deletions, (cost - subs - dels)::INT AS insertions, round(cost / nullif(len(a), 0)::DOUBLE, 6) AS wer
  FROM w JOIN cells ON cells.id = w.id AND cells.i = len(a) AND cells.j = len(b)"""

ORACLE_SQL = {
    "wer": _WER,
    "line_message_assembly": r"""SELECT conv_id::VARCHAR AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, role AS author, md5(regexp_replace(replace(text, chr(13), ''), '\s+$', '')) AS body_md5, 'dmy' AS "order",
      strftime(make_timestamp(2021, turn % 12 + 1, conv_id % 28 + 1, 10, turn % 60, 0), '%Y-%m-%d %H:%M') AS sent FROM conversations""",
    "chat_header_forms": r"""SELECT conv_id::VARCHAR AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, CASE WHEN conv_id % 3 = 0 THEN 'ios' ELSE 'android' END AS platform, role AS author,
      md5(regexp_replace(replace(text, chr(13), ''), '\s+$', '')) AS body_md5, ['dmy', 'mdy', 'ymd'][(conv_id % 3 + 1)::INT] AS "order",
      strftime(make_timestamp(2021, turn % 12 + 1, conv_id % 15 + 13, CASE WHEN conv_id % 3 = 0 THEN 10 ELSE 22 END, turn % 60, 0), '%Y-%m-%d %H:%M') AS sent FROM conversations""",
    "vote_all_orders": """WITH v AS (SELECT o_custkey, o_custkey % 3 AS form, count(*) FILTER (day(o_orderdate) > 12) AS late, count(*) AS n FROM orders GROUP BY o_custkey),
      c AS (SELECT o_custkey, CASE WHEN form = 0 THEN late ELSE 0 END AS dmy, CASE WHEN form = 1 THEN late ELSE 0 END AS mdy, CASE WHEN form = 2 THEN n ELSE 0 END AS ymd FROM v)
      SELECT *, CASE WHEN ymd > dmy + mdy THEN 'ymd' WHEN mdy > dmy THEN 'mdy' ELSE 'dmy' END AS "order" FROM c""",
    "vote_date_order": """SELECT o_custkey, count(*) FILTER (day(o_orderdate) > 12) AS dmy, 0::BIGINT AS mdy, 0::BIGINT AS ymd, 'dmy' AS "order" FROM orders GROUP BY o_custkey""",
    "linkedin_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 5 = 4 THEN ' 10:20:30' ELSE ' 00:00:00' END AS read FROM orders",
    "apple_dates": "SELECT event_id, strftime(TIMESTAMP '2001-01-01' + to_seconds(100000 + event_id * 86400 % 90000000), '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "telegram_records": """SELECT conv_id::VARCHAR AS chat, 'message:' || (turn % 7) AS sourceRef, role AS author, md5(nullif(trim(text, ' '), '')) AS body_md5, strftime(make_timestamp((1600000000 + turn * 60)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS at
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 7 ORDER BY turn) AS r FROM conversations) WHERE r = 1 AND turn % 5 <> 4""",
    "thread_records": """SELECT 'x/messages/inbox/t' || conv_id || '/message_1.json#' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ':text' AS sourceRef, role AS author,
      md5(CASE WHEN turn % 4 <> 3 THEN trim(text, ' ') ELSE '' END) AS body_md5, strftime(make_timestamp((1600000000 + turn)::BIGINT * 1000000), '%H:%M:%S') AS at FROM conversations""",
    "sidecar_match": f"""WITH {_RULED}, c AS (SELECT o.dir, o.name, s.json, CASE WHEN s.json = o.name || '.json' THEN 0 WHEN regexp_matches(o.name, '\\(2\\)') AND s.json = replace(o.name, '(2).jpg', '.jpg(2).json') THEN 1
        WHEN starts_with(o.name, replace(s.json, '.json', '')) THEN 1000000 - length(replace(s.json, '.json', '')) END AS rule FROM own o JOIN side s ON s.dir = o.dir)
      SELECT o.dir, o.name, arg_min(json, rule) AS sidecar FROM own o LEFT JOIN c ON c.dir = o.dir AND c.name = o.name AND rule IS NOT NULL GROUP BY o.dir, o.name""",
    "mailbox_messages": """SELECT coalesce(source, 'none') AS file, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) AS index, md5('Subject: s' || chr(10) || chr(10) || 'From here' || chr(10) || text) AS raw_md5 FROM documents""",
    "transcript_segments": """SELECT conv_id, CAST(count(*) FILTER (k) AS INT) AS segments, min(turn * 1.5::DOUBLE) FILTER (k) AS first_start, md5(coalesce(string_agg(trim(text, ' '), ' ' ORDER BY turn) FILTER (k), '')) AS text_md5
      FROM (SELECT *, turn % 6 <> 5 AND trim(text, ' ') <> '' AS k FROM conversations) GROUP BY conv_id""",
    "transcription_drain": f"""WITH {t.ITEMS} SELECT id, CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' ELSE 'failed' END AS status FROM items WHERE media_type IN ('audio', 'video') AND id % 7 <> 0 AND id % 4 <> 2""",
    "media_kinds": f"""SELECT p_partkey, CASE {_EXT} WHEN '.jpg' THEN 'photo' WHEN '.MP4' THEN 'video' WHEN '.opus' THEN 'audio' WHEN '.pdf' THEN 'document' END AS media_type,
      CASE {_EXT} WHEN '.jpg' THEN 'image/jpeg' WHEN '.MP4' THEN 'video/mp4' WHEN '.opus' THEN 'audio/opus' WHEN '.pdf' THEN 'application/pdf' END AS mime,
      CASE {_EXT} WHEN '.jpg' THEN 'photo' WHEN '.MP4' THEN 'video' WHEN '.opus' THEN 'audio' ELSE 'document' END AS kept_as,
      CASE {_EXT} WHEN '.jpg' THEN 'image/jpeg' WHEN '.MP4' THEN 'video/mp4' WHEN '.opus' THEN 'audio/opus' WHEN '.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS content_type FROM part""",
    "safe_paths": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'photos/' || p_name WHEN 1 THEN 'photos/sub/' || p_name END AS path FROM part",
    "scalar_labels": """SELECT o_orderkey, (floor(o_totalprice / 100)::BIGINT // 60) || ':' || lpad((floor(o_totalprice / 100)::BIGINT % 60)::VARCHAR, 2, '0') AS duration, strftime(o_orderdate, '%B %Y') AS month,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, o_totalprice / 200000::DOUBLE - 0.2::DOUBLE)) AS clamped, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM orders""",
    "event_activity": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
