"""Chat logs as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.dates import chat_date, date_order, date_votes
from keepsake.functions.media import classify
from keepsake.functions.text import nfc
from keepsake.operators.graph import cut
from keepsake.sources.lines import read_lines, running
from keepsake.sources.records import dated, records, skips

__all__ = ["attachment", "chat_name", "header", "messages", "read", "read_lines"]

#: Marks of direction and the byte order mark, which exports put around names and at the front of lines.
MARKS = "".join(map(chr, (0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFEFF)))
_BLANKS = " \t\n\r\x0b\x0c\u00a0"
#: What the exports write behind the name of an attached file, in parentheses.
ATTACHED = ("file attached", "archivo adjunto", "arquivo anexado", "ficheiro anexado", "fichier joint", "datei angehängt", "file allegato", "bestand bijgevoegd")
#: Notes that stand for a medium which an export left out: what it was, and that it is not there, by language.
LEFT_OUT = {
    ("media", "image", "photo", "video", "video note", "audio", "voice message", "sticker", "gif", "document", "contact card", "location"): ("omitted",),
    ("multimedia", "archivo", "imagen", "foto", "video", "vídeo", "audio", "mensaje de voz", "sticker", "gif", "documento", "tarjeta de contacto", "ubicación"): ("omitido", "omitida", "oculto"),
    ("mídia", "multimédia", "ficheiro", "arquivo", "arquivo de mídia", "imagem", "foto", "vídeo", "áudio", "mensagem de voz", "figurinha", "gif", "documento", "cartão do contato"): ("omitido", "omitida", "oculto", "oculta", "ocultado", "ocultada"),
}
OMITTED = tuple(sorted({f"{what} {gone}" for whats, gones in LEFT_OUT.items() for what in whats for gone in gones}))
#: A header stands in so many characters at the front of a line; an author's name is no longer than the second.
HEADER_CHARS, AUTHOR_CHARS = 160, 160
LINE, FILE = "line_no", "file"


def header(line: Column) -> Column:
    """struct(date, time, ampm, bracket, length) of the header that begins a line without leading marks; null if none does.

    A header is read as numbers and what stands between them: three of the date, joined by - / or . and
    perhaps a space; a comma or dot, a space and perhaps a word; two or three of the time; then perhaps am or
    pm, a bracket, and a dash or colon before a space. Android exports have a dash, others brackets.
    """
    bracket = line.startswith("[")
    text = F.substring(F.when(bracket, F.substring(line, 2, HEADER_CHARS)).otherwise(line), 1, HEADER_CHARS)
    numbers, gaps = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.split(text, "[0-9]+", 8)
    n, gap = (lambda i: F.get(numbers, F.lit(i))), (lambda i: F.get(gaps, F.lit(i)))
    up_to = lambda i, digits: F.length(n(i)).between(1, digits)
    joins = [d + s for d in "-/." for s in ("", " ", "\t", "\u00a0")]
    dated = (gap(0) == "") & up_to(0, 4) & up_to(1, 4) & up_to(2, 4) & gap(1).isin(joins) & gap(2).isin(joins)
    apart = F.ltrim(F.substring(gap(3), 1, 1), F.lit(",."))  # '' if a comma or dot is first
    blank = F.when(apart == "", F.substring(gap(3), 2, 1)).otherwise(apart).rlike(r"^\s$")
    timed = up_to(3, 2) & up_to(4, 2) & gap(4).isin(":", ".")
    seconds = gap(5).isin(":", ".") & F.coalesce(up_to(5, 2), F.lit(False))
    tail = F.when(seconds, gap(6)).otherwise(gap(5))
    noon = F.regexp_extract(tail, r"^\s[AaPp][.\s]{0,2}[Mm]\.?", 0)
    after = F.substring(tail, F.length(noon) + 1, F.lit(HEADER_CHARS))
    after = F.when(after.startswith("]"), F.substring(after, 2, HEADER_CHARS)).otherwise(after)
    after = F.when(after.startswith(":"), F.substring(after, 2, HEADER_CHARS)).when(after.rlike(r"^\s-"), F.substring(after, 3, HEADER_CHARS)).otherwise(after)
    date = F.concat(n(0), gap(1), n(1), gap(2), n(2))
    time = F.concat(n(3), gap(4), n(4), F.when(seconds, F.concat(gap(5), n(5))).otherwise(""))
    length = bracket.cast("int") + F.length(date) + F.length(gap(3)) + F.length(time) + F.length(tail) - F.length(after) + 1
    return F.when(dated & blank & timed & after.rlike(r"^\s"), F.struct(date.alias("date"), time.alias("time"), F.nullif(F.trim(noon), F.lit("")).alias("ampm"), bracket.alias("bracket"), length.alias("length")))


def _author(text: Column) -> Column:
    """What stands before the first colon if a space follows it and it can be a name."""
    name = F.substring_index(text, ":", 1)
    fits = F.substring(text, F.length(name) + 1, F.lit(2)) == ": "
    return F.when(fits & F.length(name).between(1, AUTHOR_CHARS) & ~name.rlike("[\n<>]"), name)


def messages(lines: DataFrame) -> DataFrame:
    """(file, index, date, time, ampm, platform, author, body, order) of each message.

    A line with a header begins a message, other lines go on with it. The order of day and month is voted by
    the headers up to the next one.
    """
    rows = lines.select(FILE, LINE, F.regexp_replace("value", "\r$", "").alias("raw")).withColumn("line", F.ltrim("raw", F.lit(MARKS))).withColumn("head", header(F.col("line")))
    # Headers are read once, whatever is summed over them.
    rows = running(cut(rows), {"index": F.col("head").isNotNull()}, FILE, LINE)
    texts = F.transform(F.sort_array(F.collect_list(F.struct(LINE, "raw"))), lambda x: x["raw"])
    put = rows.filter("index > 0").groupBy(FILE, "index").agg(F.max("head").alias("head"), F.max(F.when(F.col("head").isNotNull(), F.col("line"))).alias("line"), texts.alias("texts"))
    put = put.select(FILE, "index", "head.date", "head.time", "head.ampm", F.when(F.col("head.bracket"), "ios").otherwise("android").alias("platform"),
                     F.ltrim(F.substring("line", F.col("head.length") + 1, F.length("line")), F.lit(MARKS)).alias("first"), F.slice("texts", 2, 1 << 30).alias("more"))
    votes = dict(zip(("dmy", "mdy", "ymd"), date_votes(F.col("date")), strict=True))
    counted = running(cut(put), votes, FILE, "index", ahead=True).withColumn("order", date_order(*[F.col(n) for n in votes]))
    author = _author(F.col("first"))
    body = F.when(author.isNotNull(), F.substring("first", F.length(author) + 3, F.length("first"))).otherwise(F.col("first"))
    whole = F.array_join(F.concat(F.array(F.ltrim(body, F.lit(MARKS))), "more"), "\n")
    return counted.select(FILE, "index", "date", "time", "ampm", "platform", F.trim(author).alias("author"), F.rtrim(whole, F.lit(MARKS + _BLANKS)).alias("body"), "order")


def attachment(body: Column) -> tuple[Column, Column]:
    """The file that a message's marker names, and the caption without the marker; the file is null where there is no marker.

    <attached: name> in one app's exports, name (file attached) in the other's, in the languages of ATTACHED.
    """
    inner = F.substring_index(F.substring(body, 2, F.length(body)), ">", 1)
    told = F.trim(F.substring(inner, F.locate(":", inner) + 1, F.length(inner)))
    angled = body.startswith("<") & body.contains(">") & inner.contains(":") & (told != "")
    clean = F.translate(body, "\u200e", "")
    low = F.lower(clean)
    where = F.least(*[F.nullif(F.locate(f"({phrase})", low), F.lit(0)) for phrase in ATTACHED], F.lit(1 << 30))
    name = F.substring(clean, F.lit(1), where - 2)
    marked = (where > 2) & (where < 1 << 30) & F.substring(clean, where - 1, F.lit(1)).rlike(r"^\s$") & ~name.contains("\n")
    length = F.length(F.substring_index(F.substring(clean, where, F.length(clean)), ")", 1)) + 1
    rest = F.substring(clean, where + length, F.length(clean))
    file = F.when(angled, told).when(marked, name)
    caption = F.when(angled, F.substring(body, F.length(inner) + 3, F.length(body))).when(marked, rest).otherwise(body)
    return nfc(F.trim(F.translate(file, MARKS, ""))), F.nullif(F.trim(caption, F.lit(_BLANKS)), F.lit(""))


def _left_out(body: Column) -> Column:
    """Whether a message is nothing but a note that a medium was left out, in angle brackets or not."""
    return F.lower(F.trim(F.translate(body, MARKS + "<>.", ""), F.lit(_BLANKS))).isin(*OMITTED)


def chat_name(path: Column) -> Column:
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.(zip|txt)$", "")
    return F.trim(F.regexp_replace(name, r"(?i)^WhatsApp Chat( with| -)?\s*", ""))


def read(lines: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, skips) of chat logs; files (name) are the attachments that there are."""
    file, caption = attachment(F.col("body"))
    m = messages(lines).withColumns({"named": file, "caption": caption})
    ref = F.concat_ws(":", F.lit("msg"), F.col("index").cast("string"))
    if files is None:
        m = m.withColumn("there", F.lit(False))
    else:
        there = files.select(nfc(F.trim(F.translate("name", MARKS, ""))).alias("named"), F.lit(True).alias("there")).distinct()
        m = m.join(there, "named", "left")
    lost = m.filter(F.col("named").isNotNull() & ~F.coalesce("there", F.lit(False)))
    kind, mime = classify(F.col("named"), source="whatsapp")
    has = F.col("named").isNotNull() & F.coalesce("there", F.lit(False))
    meta = F.struct(chat_name(F.col(FILE)).alias("chat"), "platform", F.when(_left_out(F.col("body")), True).alias("mediaOmitted"))
    when = chat_date(F.col("date"), F.col("time"), F.col("ampm"), F.col("order"))
    kept = records(m, sourceType=F.lit("whatsapp"), mediaType=F.when(has, kind).otherwise("message"), originalPath=F.when(has, F.col("named")), mimeType=F.when(has, mime), date=dated(when),
                   author=F.col("author"), body=F.when(F.col("named").isNotNull(), F.col("caption")).otherwise(F.nullif("body", F.lit(""))), sourceRef=ref, sourceMeta=meta)
    begins = header(F.ltrim("value", F.lit(MARKS))).isNotNull()
    early = lines.filter(~begins).join(lines.filter(begins).groupBy(FILE).agg(F.min(LINE).alias("_first")), FILE, "left").filter(
        (F.col(LINE) < F.coalesce("_first", F.lit(1 << 62))) & (F.trim("value") != ""))
    return kept, skips(early, F.concat(F.lit("line:"), (F.col(LINE) + 1).cast("string")), "unparseable line before first message", "E_PARSE").union(
        skips(lost, ref, "attachment is missing", "E_ATTACHMENT_MISSING"))
