"""Folders, zip archives, photo sidecars, mailboxes, Apple message tables, gazetteers."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.dates import apple_date, epoch
from keepsake.functions.media import classify
from keepsake.functions.text import unescape_mbox
from keepsake.operators.graph import spread
from keepsake.sources.lines import running
from keepsake.sources.records import dated, nonempty, records, skips

MESSAGE_CHARS = 4 * 1024 * 1024


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length) of all files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def folder(files: DataFrame, root: str, exif: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A record for each file of a known kind, dated by its EXIF (path, taken, lat, lon) if there is some, else by its change."""
    kind, mime = classify(F.col("path"))
    known = files.withColumn("kind", kind).withColumn("mime", mime).filter("kind is not null")
    e = None if exif is None else exif.select("path", "taken", "lat", "lon")
    known = known.withColumns({c: F.lit(None).cast(t) for c, t in (("taken", "timestamp"), ("lat", "double"), ("lon", "double"))}) if e is None else known.join(e, "path", "left")
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~((F.col("lat") == 0) & (F.col("lon") == 0)), F.struct("lat", "lon", F.lit(None).cast("double").alias("alt")))
    when = F.when(F.col("taken").isNotNull(), dated(F.col("taken"), "exif")).otherwise(dated(F.col("modified"), "mtime"))
    ref = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), r"\\", "/")
    kept = records(known, sourceType=F.lit("folder"), mediaType=F.col("kind"), originalPath=F.col("path"), mimeType=F.col("mime"), date=when, gps=place, sourceRef=ref)
    return kept, skips(files.limit(0), F.col("path"), "", "")


def sidecars(media: DataFrame, jsons: DataFrame) -> DataFrame:
    """(dir, name, sidecar) for media (dir, name) and JSON files (dir, json): name.json, else name(1).jpg with name.jpg(1).json,
    else the longest stem of at least four characters that begins the name.

    The first two are equality joins. The third joins a name's own prefixes, so that a folder is never paired with itself.
    Either side has a row a file, so that all joins are shuffled and sorted: small files on disk must not have a side broadcast.
    """
    dup = r"^(.*)\((\d+)\)(\.[^.]+)$"
    n = F.col("name")
    own = spread(media.select("dir", "name")).select("dir", "name", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("rule"), F.concat(n, F.lit(".json")).alias("json"))),
        F.when(n.rlike(dup), F.array(F.struct(F.lit(1).alias("rule"), F.concat(F.regexp_extract(n, dup, 1), F.regexp_extract(n, dup, 3), F.lit("("), F.regexp_extract(n, dup, 2), F.lit(").json")).alias("json")))).otherwise(F.array()),
        F.when(F.length(n) >= 4, F.transform(F.sequence(F.lit(4), F.length(n)), lambda i: F.struct((F.lit(1_000_000) - i).alias("rule"), F.concat(F.left(n, i), F.lit(".json")).alias("json")))).otherwise(F.array()))).alias("t"))
    there = jsons.select("dir", F.col("json").alias("sidecar"), F.concat(F.regexp_replace("json", r"(?i)\.json$", ""), F.lit(".json")).alias("json"))
    hits = own.select("dir", "name", "t.rule", "t.json").join(there.hint("merge"), ["dir", "json"])
    best = hits.groupBy("dir", "name").agg(F.min_by("sidecar", F.struct("rule", "sidecar")).alias("sidecar"))
    return media.select("dir", "name").join(best.hint("merge"), ["dir", "name"], "left")


_SIDECAR = ("struct<title: string, description: string, photoTakenTime: struct<timestamp: string>, creationTime: struct<timestamp: string>, "
            "geoData: struct<latitude: double, longitude: double, altitude: double>>")


def sidecar_fields(raw: Column) -> tuple[Column, Column, Column]:
    """(date, gps, description) of a sidecar's text; the date taken before that of creation, no place at (0, 0)."""
    s = F.from_json(raw, _SIDECAR)
    geo = s["geoData"]
    there = geo["latitude"].isNotNull() & geo["longitude"].isNotNull() & ~((geo["latitude"] == 0) & (geo["longitude"] == 0))
    gps = F.when(there, F.struct(geo["latitude"].alias("lat"), geo["longitude"].alias("lon"), F.nullif(geo["altitude"], F.lit(0.0)).alias("alt")))
    return F.coalesce(epoch(s["photoTakenTime"]["timestamp"]), epoch(s["creationTime"]["timestamp"])), gps, F.nullif(s["description"], F.lit(""))


def photos(media: DataFrame, jsons: DataFrame) -> DataFrame:
    """Records of media (dir, name, modified) with their sidecars (dir, json, text)."""
    told = jsons.select("dir", F.col("json").alias("sidecar"), "text")
    paired = media.join(sidecars(media, jsons).hint("merge"), ["dir", "name"], "left").join(told.hint("merge"), ["dir", "sidecar"], "left")
    when, gps, told = sidecar_fields(F.col("text"))
    kind, mime = classify(F.col("name"))
    date = F.when(when.isNotNull(), dated(when, "sidecar")).otherwise(dated(F.col("modified"), "mtime"))
    path = F.concat_ws("/", "dir", "name")
    return records(paired.filter(kind.isNotNull()), sourceType=F.lit("takeout"), mediaType=kind, originalPath=path, mimeType=mime, date=date, gps=gps, body=told, sourceRef=path)


def mbox_messages(lines: DataFrame) -> DataFrame:
    """(file, index, raw) from lines (file, line_no, value): a line that begins 'From ' starts a message; '>From ' loses one mark."""
    starts = F.col("value").startswith("From ")
    numbered = running(lines, {"index": starts}).filter((F.col("index") > 0) & ~starts)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("line_no", unescape_mbox(F.col("value")).alias("v")))), lambda x: x["v"])
    return numbered.groupBy("file", "index").agg(F.array_join(texts, "\n").alias("raw"))


def mbox(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skips) of mail: sender, date, subject, plain text; attachments as rows of their own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, index, raw in zip(batch["file"], batch["index"], batch["raw"], strict=True):
                ref = f"{file.rsplit('/', 1)[-1]}#{index}"
                if len(raw) > MESSAGE_CHARS:
                    rows.append((ref, "skip", "message is too large", "E_TOO_LARGE", None, None, None))
                    continue
                m = email.message_from_string(raw, policy=email.policy.default)
                if not m.keys():
                    rows.append((ref, "skip", "message has no headers", "E_PARSE", None, None, None))
                    continue
                try:
                    when = m["date"].datetime.isoformat() if m["date"] is not None and m["date"].datetime else None
                except (AttributeError, ValueError, TypeError):
                    when = None
                part = m.get_body(("plain", "html"))
                body = None if part is None else str(part.get_content()).strip() or None
                rows.append((ref, "message", body, str(m["from"]) if m["from"] else None, when, str(m["subject"]) if m["subject"] else None, None))
                for k, a in enumerate(m.iter_attachments()):
                    rows.append((f"{ref}:attachment:{k}", "attachment", a.get_filename() or "attachment", str(m["from"]) if m["from"] else None, when, a.get_content_type(), None))
            yield pd.DataFrame(rows, columns=["ref", "what", "a", "b", "c", "d", "e"])

    found = mbox_messages(lines).mapInPandas(run, "ref string, what string, a string, b string, c string, d string, e string")
    when = dated(F.col("c").try_cast("timestamp"))
    mail = records(found.filter("what = 'message'"), sourceType=F.lit("takeout"), mediaType=F.lit("message"), date=when, author=F.col("b"), body=F.col("a"), sourceRef=F.col("ref"), sourceMeta=F.struct(F.col("d").alias("subject")))
    kind, mime = classify(F.col("a"), F.col("d"))
    files = records(found.filter("what = 'attachment'"), sourceType=F.lit("takeout"), mediaType=F.coalesce(kind, F.lit("document")), mimeType=F.coalesce(mime, F.col("d")), date=when, author=F.col("b"), body=F.col("a"), sourceRef=F.col("ref"))
    return mail.union(files), found.filter("what = 'skip'").select("ref", F.col("a").alias("reason"), F.col("b").alias("code"))


def imessage(message: DataFrame, handle: DataFrame, chat: DataFrame, chat_message: DataFrame, attachment: DataFrame | None = None, message_attachment: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, skips) from the tables of a message database: a record for a message's text and one for each attachment of a known kind."""
    chats = chat_message.join(chat.select(F.col("ROWID").alias("chat_id"), F.col("guid").alias("cg"), F.col("display_name").alias("cn")), "chat_id", "left")
    listed = lambda c: F.transform(F.sort_array(F.collect_set(F.when(F.col(c).isNotNull(), F.struct("chat_id", F.col(c).alias("v"))))), lambda x: x["v"])
    of = chats.groupBy(F.col("message_id").alias("ROWID")).agg(F.min_by("cg", "chat_id").alias("chatGuid"), F.min_by("cn", "chat_id").alias("chatName"), listed("cg").alias("chatGuids"), listed("cn").alias("chatNames"))
    m = message.join(handle.select(F.col("ROWID").alias("handle_id"), F.col("id").alias("handle")), "handle_id", "left").join(of, "ROWID", "left")
    if attachment is not None and message_attachment is not None:
        a = message_attachment.join(attachment.select(F.col("ROWID").alias("attachment_id"), "filename", "mime_type", "transfer_name"), "attachment_id").withColumnRenamed("message_id", "ROWID")
    else:
        a = m.select("ROWID").limit(0).withColumns({c: F.lit(None).cast("string") for c in ("filename", "mime_type", "transfer_name")}).withColumn("attachment_id", F.lit(None).cast("long"))
    ref = F.concat(F.lit("message:"), F.col("ROWID").cast("string"))
    author = F.when(F.col("is_from_me") == 1, "Me").otherwise(F.col("handle"))
    meta = F.struct("guid", "chatGuid", "chatName", "chatGuids", "chatNames", "service")
    common = {"sourceType": F.lit("imessage"), "date": dated(apple_date(F.col("date"))), "author": author, "body": F.col("text"), "sourceMeta": meta}
    texts = records(m.filter("text is not null"), mediaType=F.lit("message"), sourceRef=ref, **common)
    raw = F.translate(F.coalesce("filename", "transfer_name"), "\\", "/")
    rel = F.array_join(F.array_remove(F.split(F.when(raw.contains("/Attachments/"), F.substring_index(raw, "/Attachments/", -1)).otherwise(F.regexp_replace(raw, r"^(Attachments/|~?/*(Library/Messages/)?)", "")), "/"), ""), "/")
    each = m.join(a, "ROWID").withColumn("path", F.when(~rel.rlike(r"(^|/)\.{1,2}(/|$)") & (rel != ""), rel)).withColumn("ref", F.concat(ref, F.lit(":attachment:"), F.col("attachment_id").cast("string")))
    kind, mime = classify(F.coalesce("transfer_name", "path"), F.col("mime_type"))
    files = records(each.filter(F.col("path").isNotNull() & kind.isNotNull()), mediaType=kind, originalPath=F.col("path"), mimeType=F.coalesce("mime_type", mime), sourceRef=F.col("ref"), **common)
    bare = m.filter("text is null").join(a.select("ROWID").distinct(), "ROWID", "left_anti")
    return texts.union(files), skips(bare, ref, "message has no text or supported attachment", "E_EMPTY_MESSAGE").union(
        skips(each.filter("path is null"), F.col("ref"), "attachment path is missing or unsafe", "E_ATTACHMENT_PATH")).union(
            skips(each.filter(F.col("path").isNotNull() & kind.isNull()), F.col("ref"), "attachment type is not supported", "E_ATTACHMENT_TYPE"))


GAZETTEER = "id long, name string, lat double, lon double, admin1 string, country string"


def gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, malformed lines) of a newline-delimited JSON gazetteer."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", f"struct<{', '.join(x.replace(' ', ': ', 1) for x in GAZETTEER.split(', '))}>").alias("g"))
    whole = F.col("g.id").isNotNull() & F.col("g.name").isNotNull() & F.col("g.lat").between(-90, 90) & F.col("g.lon").between(-180, 180)
    return lines.filter(whole).select("g.*"), lines.filter(~F.coalesce(whole, F.lit(False))).select("value")


def pack_gazetteer(spark: SparkSession, tsv: str, limit: int = 128) -> DataFrame:
    """The most populous places of a tab-separated table (columns 0, 1, 4, 5, 8, 10, 14), by population, then id."""
    raw = spark.read.csv(tsv, sep="\t", quote="")
    c = raw.columns
    rows = raw.select(F.col(c[0]).cast("long").alias("id"), F.trim(c[1]).alias("name"), F.col(c[4]).cast("double").alias("lat"), F.col(c[5]).cast("double").alias("lon"),
                      nonempty(F.col(c[10])).alias("admin1"), nonempty(F.col(c[8])).alias("country"), F.coalesce(F.col(c[14]).cast("long"), F.lit(0)).alias("population"))
    return rows.orderBy(F.col("population").desc(), "id").limit(limit)


#: Markers by which an export is known, most specific first; a folder is what is left.
MARKERS = (("imessage", ("chat.db",)), ("instagram", ("your_instagram_activity/messages/",)), ("messenger", ("messages/inbox/",)), ("facebook", ("your_facebook_activity/", "posts/your_posts", "photos_and_videos/album")),
           ("linkedin", ("Connections.csv", "messages.csv", "Rich_Media.csv")), ("telegram", ("result.json",)), ("takeout", (".mbox", "Takeout/")), ("whatsapp", ("_chat.txt", "WhatsApp Chat")), ("folder", ("",)))


def select_source(paths: list[str]) -> str:
    """The source that some listed path speaks for."""
    return next(name for name, marks in MARKERS if any(m in p for p in paths for m in marks) or name == "folder")
