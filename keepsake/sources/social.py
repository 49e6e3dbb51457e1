"""JSON exports: Facebook posts, threads and albums; Messenger and Instagram threads; Telegram chats."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.dates import epoch, telegram_date
from keepsake.functions.media import classify, safe_media_path
from keepsake.functions.text import bounded, repair_mojibake
from keepsake.sources.guards import fits
from keepsake.sources.records import dated, nonempty, records, skips

_MEDIA = "struct<uri: string, creation_timestamp: string, description: string>"
_MEDIA_FIELDS = ("photos", "videos", "audio_files", "gifs", "files")
_POST = f"struct<timestamp: string, title: string, data: array<struct<post: string, media: {_MEDIA}>>, attachments: array<struct<data: array<struct<media: {_MEDIA}>>>>>"
_MESSAGE = "struct<sender_name: string, timestamp_ms: string, content: string, sticker: " + _MEDIA + ", " + ", ".join(f"{f}: array<{_MEDIA}>" for f in _MEDIA_FIELDS) + ">"
_THREAD = "struct<title: string, thread_path: string, participants: array<struct<name: string>>, messages: array<string>>"
_ALBUM = "struct<name: string, photos: array<string>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of JSON files, whole; file is relative to nothing."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _entries(files: DataFrame, text: Column) -> DataFrame:
    """(file, text, i, raw): the elements of a JSON array, each still text."""
    return files.select("file", F.posexplode(F.from_json(text, "array<string>")).alias("i", "raw"))


def _resolved(found: DataFrame, entries: DataFrame | None, uri: str = "uri") -> DataFrame:
    """found with path: the entry (path) that a URI names by its whole path, by a suffix that only one entry has, or by base name.

    Entries are read from the export itself; a URI is never made into a path of its own.
    """
    if entries is None:
        return found.withColumn("path", F.lit(None).cast("string"))
    clean = found.withColumn("_u", F.regexp_replace(uri, r"^\.?/", ""))
    parts = F.split("path", "/")
    tails = entries.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("_u"))
    whole = tails.filter(F.col("_u") == F.col("path")).select("_u", F.col("path").alias("_p0"))
    one = tails.groupBy("_u").agg(F.min("path").alias("_p1"), F.countDistinct("path").alias("_n")).filter("_n = 1").drop("_n")
    base = entries.groupBy(F.substring_index("path", "/", -1).alias("_b")).agg(F.max("path").alias("_p2"))
    joined = clean.join(whole, "_u", "left").join(one, "_u", "left").withColumn("_b", F.substring_index("_u", "/", -1)).join(base, "_b", "left")
    return joined.withColumn("path", F.coalesce("_p0", "_p1", "_p2")).drop("_u", "_b", "_p0", "_p1", "_p2")


def facebook_posts(files: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A record for each medium that is there, one for the text, and one for a post that has neither."""
    raw = _entries(files, F.col("text"))
    good = raw.filter(F.ltrim("raw").startswith("{")).withColumn("p", F.from_json("raw", _POST))
    ref = F.concat("file", F.lit("#"), F.col("i").cast("string"))
    media = F.concat(F.flatten(F.transform(F.coalesce("p.attachments", F.array()), lambda a: F.transform(F.coalesce(a["data"], F.array()), lambda x: x["media"]))),
                     F.transform(F.coalesce("p.data", F.array()), lambda x: x["media"]))
    posts = good.select(ref.alias("ref"), "p", F.filter(media, lambda m: m.isNotNull()).alias("media"),
                        F.nullif(F.array_join(F.filter(F.transform(F.coalesce("p.data", F.array()), lambda x: repair_mojibake(x["post"])), lambda t: t.isNotNull()), "\n"), F.lit("")).alias("body"))
    each = _resolved(posts.select("ref", "p.timestamp", F.posexplode("media").alias("m", "medium")).select("*", F.col("medium.uri").alias("uri")), entries)
    there = each.filter("path is not null")
    kind, mime = classify(F.col("path"), source="facebook")
    media_records = records(there, sourceType=F.lit("facebook"), mediaType=kind, originalPath=F.col("path"), mimeType=mime, date=dated(F.coalesce(epoch(F.col("medium.creation_timestamp")), epoch(F.col("timestamp")))),
                            body=repair_mojibake(F.col("medium.description")), sourceRef=F.concat("ref", F.lit(":media:"), F.col("m").cast("string")), sourceMeta=F.struct(F.lit("post").alias("kind")))
    texts = posts.join(there.select("ref").distinct().withColumn("_m", F.lit(True)), "ref", "left").filter("body is not null or _m is null")
    text_records = records(texts, sourceType=F.lit("facebook"), mediaType=F.lit("message"), date=dated(epoch(F.col("p.timestamp"))), body=F.col("body"), sourceRef=F.concat("ref", F.lit(":text")),
                           sourceMeta=F.struct(F.lit("post").alias("kind")))
    bad = skips(raw.filter(~F.ltrim("raw").startswith("{")), ref, "post entry is not an object", "E_PARSE")
    return media_records.union(text_records), bad.union(skips(each.filter("path is null"), F.concat("ref", F.lit(":media:"), F.col("m").cast("string")), "media is missing", "E_MEDIA_MISSING"))


def threads(files: DataFrame, source: str = "facebook", entries: DataFrame | None = None, buckets: tuple[str, ...] = (), root_required: bool = False) -> tuple[DataFrame, DataFrame]:
    """Message threads. Every message makes at least one record: its media that are there, its text, or itself without either.

    buckets are the folders under messages/ that count (all if none are named).
    """
    if buckets:
        files = files.filter(F.col("file").rlike(("/" if root_required else "(^|/)") + "messages/(" + "|".join(buckets) + ")/"))
    head = files.select("file", "text", F.from_json("text", _THREAD).alias("t"))
    odd = head.filter(F.col("t.messages").isNull())
    raw = head.filter(F.col("t.messages").isNotNull()).select("file", F.struct(repair_mojibake(F.col("t.title")).alias("threadTitle"), F.col("t.thread_path").alias("threadPath"),
        F.transform("t.participants", lambda p: repair_mojibake(p["name"])).alias("participants")).alias("meta"), F.posexplode("t.messages").alias("i", "raw"))
    ref = F.concat("file", F.lit("#"), F.col("i").cast("string"))
    fit = F.ltrim("raw").startswith("{") & fits(F.col("raw"))
    m = raw.filter(fit).select(ref.alias("ref"), "meta", F.from_json("raw", _MESSAGE).alias("m"))
    tailed = lambda f: F.transform(F.coalesce(f"m.{f}", F.array()), lambda x, i: F.struct(F.concat(F.lit(f":{f}:"), i.cast("string")).alias("tail"), x.alias("medium")))
    lists = [tailed(f) for f in _MEDIA_FIELDS]
    sticker = F.when(F.col("m.sticker").isNotNull(), F.array(F.struct(F.lit(":sticker").alias("tail"), F.col("m.sticker").alias("medium")))).otherwise(F.array())
    each = _resolved(m.select("ref", "meta", "m", F.explode(F.concat(*lists, sticker)).alias("x")).select("ref", "meta", "m", "x.tail", F.col("x.medium").alias("medium"), F.col("x.medium.uri").alias("uri")), entries)
    there = each.filter("path is not null")
    kind, mime = classify(F.col("path"), source="facebook")
    common = lambda body, tail, **more: {"sourceType": F.lit(source), "date": dated(epoch(F.col("m.timestamp_ms"), 1000)), "author": repair_mojibake(F.col("m.sender_name")), "body": body,
                                         "sourceRef": F.concat("ref", tail), "sourceMeta": F.col("meta"), **more}
    media_records = records(there, **common(repair_mojibake(F.col("medium.description")), F.col("tail"), mediaType=kind, originalPath=F.col("path"), mimeType=mime))
    body = nonempty(repair_mojibake(F.col("m.content")))
    texts = m.join(there.select("ref").distinct().withColumn("_m", F.lit(True)), "ref", "left").filter(body.isNotNull() | F.col("_m").isNull())
    text_records = records(texts, **common(body, F.lit(":text"), mediaType=F.lit("message")))
    skipped = skips(odd, F.col("file"), "message thread is not an object", "E_PARSE").union(skips(raw.filter(~fit), ref, "message is not an object, too large or too deep", "E_PARSE")).union(
        skips(each.filter("path is null"), F.concat("ref", "tail"), "media is missing", "E_MEDIA_MISSING"))
    return media_records.union(text_records), skipped


def messenger(files: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return threads(files, "messenger", entries, ("inbox", "archived_threads", "filtered_threads"))


def instagram(files: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return threads(files, "instagram", entries, ("inbox",), True)


def facebook_albums(files: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    album = files.select("file", F.from_json("text", _ALBUM).alias("a")).select("file", repair_mojibake(F.col("a.name")).alias("album"), F.posexplode("a.photos").alias("i", "raw"))
    ref = F.concat("file", F.lit("#photo:"), F.col("i").cast("string"))
    good = album.filter(F.ltrim("raw").startswith("{")).withColumn("medium", F.from_json("raw", _MEDIA)).withColumn("uri", F.col("medium.uri"))
    each = _resolved(good, entries)
    kind, mime = classify(F.col("path"), source="facebook")
    kept = records(each.filter("path is not null"), sourceType=F.lit("facebook"), mediaType=kind, originalPath=F.col("path"), mimeType=mime, date=dated(epoch(F.col("medium.creation_timestamp"))),
                   body=repair_mojibake(F.col("medium.description")), sourceRef=ref, sourceMeta=F.struct(F.lit("album").alias("kind"), "album"))
    return kept, skips(album.filter(~F.ltrim("raw").startswith("{")), ref, "album entry is not an object", "E_PARSE").union(skips(each.filter("path is null"), ref, "media is missing", "E_MEDIA_MISSING"))


#: Nesting and characters of a message's text.
TEXT_DEPTH, TEXT_CHARS = 20, 20_000
_CHATS = "array<struct<name: string, type: string, id: string, messages: array<string>>>"
_TELEGRAM = ("struct<id: string, type: string, date: string, date_unixtime: string, from: string, from_id: string, text: string, photo: string, file: string, media_type: string>")


def _flat(value, depth: int = 0) -> str:
    if depth > TEXT_DEPTH:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(_flat(v, depth + 1) for v in value)
    return _flat(value.get("text"), depth + 1) if isinstance(value, dict) else ""


def flat_text(raw: Column) -> Column:
    """Plain text of nested text parts, given as JSON or as itself."""
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None or not re.match(r"\s*[\[{]", t):
                return t
            try:
                return _flat(json.loads(t))[:TEXT_CHARS]
            except ValueError:
                return t
        return s.map(one)

    return F.pandas_udf(run, T.StringType())(raw)


def telegram(files: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages of all chats; service messages are skipped, media only from the export's three folders, repeats by reference once."""
    one = F.from_json("text", _CHATS[6:-1])
    listed = F.from_json(F.get_json_object("text", "$.chats.list"), _CHATS)
    chats = files.select("file", F.explode(F.filter(F.concat(F.array(one), F.coalesce(listed, F.array())), lambda c: c["messages"].isNotNull())).alias("c"))
    raw = chats.select("file", F.struct(F.col("c.id").alias("chatId"), F.col("c.name").alias("chatName"), F.col("c.type").alias("chatType")).alias("chat"), F.posexplode("c.messages").alias("i", "raw"))
    m = raw.select("file", "chat", "i", F.from_json("raw", _TELEGRAM).alias("m")).withColumn("ref", F.concat(F.lit("message:"), F.coalesce("m.id", F.lit("unknown"))))
    # The first message of a reference, in the file's order, is the one that counts.
    first = m.groupBy("file", "chat", "ref").agg(F.min_by("m", "i").alias("m"))
    service = F.col("m.type").isNotNull() & (F.col("m.type") != "message")
    body = nonempty(bounded(flat_text(F.col("m.text")), TEXT_CHARS))
    common = {"sourceType": F.lit("telegram"), "date": dated(telegram_date(F.col("m.date_unixtime"), F.col("m.date"))), "author": F.col("m.from"), "sourceMeta": F.struct("chat.*", F.col("m.from_id").alias("fromId"))}
    texts = records(first.filter(~service), mediaType=F.lit("message"), body=body, sourceRef=F.col("ref"), **common)
    refs = first.filter(~service).select("file", "chat", "ref", "m", F.explode(F.array_distinct(F.filter(F.array("m.photo", "m.file"), lambda x: x.isNotNull()))).alias("uri"))
    safe = refs.withColumn("path", safe_media_path(F.col("uri"), ("photos", "video_files", "voice_messages")))
    if entries is not None:
        safe = safe.join(entries.select("path", F.lit(True).alias("_there")), "path", "left").withColumn("path", F.when(F.col("_there"), F.col("path")))
    kind, mime = classify(F.col("path"))
    told = F.element_at(F.create_map(*map(F.lit, ("voice_message", "audio", "video_file", "video", "animation", "video", "photo", "photo"))), F.col("m.media_type"))
    media = records(safe.filter("path is not null"), mediaType=F.coalesce(kind, told), originalPath=F.col("path"), mimeType=F.coalesce(mime, F.lit("application/octet-stream")),
                    sourceRef=F.concat("ref", F.lit(":media:"), "path"), **common).filter("mediaType is not null")
    return texts.union(media), skips(first.filter(service), F.col("ref"), "service message", "E_SERVICE_MESSAGE").union(skips(safe.filter("path is null"), F.col("ref"), "media is missing or unsafe", "E_MEDIA_PATH"))


