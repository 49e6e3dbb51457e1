"""Media kinds by extension and MIME type, safe media paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of exports' media and their MIME types.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
    "heic": "image/heic", "heif": "image/heif", "avif": "image/avif", "mp4": "video/mp4", "m4v": "video/x-m4v", "mov": "video/quicktime", "avi": "video/x-msvideo",
    "mkv": "video/x-matroska", "webm": "video/webm", "wmv": "video/x-ms-wmv", "flv": "video/x-flv", "3gp": "video/3gpp", "3gpp": "video/3gpp", "opus": "audio/opus",
    "m4a": "audio/mp4", "aac": "audio/aac", "mp3": "audio/mpeg", "ogg": "audio/ogg", "oga": "audio/ogg", "wav": "audio/wav", "amr": "audio/amr", "flac": "audio/flac",
    "wma": "audio/x-ms-wma", "aiff": "audio/aiff", "aif": "audio/aiff", "pdf": "application/pdf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "rtf": "application/rtf", "vcf": "text/vcard",
    "csv": "text/csv", "odt": "application/vnd.oasis.opendocument.text",
}
UNKNOWN = "application/octet-stream"
#: Sources that keep a file of unknown kind as a document; the others pass it over.
KEEPS_UNKNOWN = ("whatsapp", "facebook")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\.]\.([A-Za-z0-9]+)$", 1))


def mime_of(path: Column) -> Column:
    """By extension; null where it is unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), extension(path))


def kind_of_mime(mime: Column) -> Column:
    head = F.lower(F.substring_index(mime, "/", 1))
    return F.when(head == "image", "photo").when(head.isin("video", "audio"), head).otherwise("document")


def classify(path: Column, mime: Column | None = None, source: str = "folder") -> tuple[Column, Column]:
    """(media_type, mime): a media MIME type wins over the extension; both null for a file that the source passes over."""
    own = mime_of(path)
    if mime is not None:
        told = F.lower(mime).rlike("^(image|video|audio)/")
        own_kind = F.when(told, kind_of_mime(mime)).otherwise(kind_of_mime(own))
        return F.when(told | own.isNotNull(), own_kind), F.when(told, mime).otherwise(own)
    if source in KEEPS_UNKNOWN:
        own = F.coalesce(own, F.lit(UNKNOWN))
    return F.when(own.isNotNull(), kind_of_mime(own)), own


def content_type(stored: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(stored, F.lit("")), mime_of(path), F.lit(UNKNOWN))


def safe_media_path(raw: Column, folders: tuple[str, ...]) -> Column:
    """A relative path without dot segments under one of the folders, with plain slashes; null for anything else."""
    unsafe = raw.contains("\x00") | raw.rlike(r"^([A-Za-z]:[\\/]|\\\\|/)")
    plain = F.array_join(F.array_remove(F.split(F.translate(raw, "\\", "/"), "/"), ""), "/")
    dots = plain.rlike(r"(^|/)\.{1,2}(/|$)")
    under = plain.rlike("^(" + "|".join(folders) + ")/")
    return F.when(raw.isNotNull() & ~unsafe & ~dots & under, plain)
