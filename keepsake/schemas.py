"""Table schemas, vocabularies and limits of the catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 5
SOURCE_TYPES = ("whatsapp", "facebook", "messenger", "instagram", "linkedin", "imessage", "telegram", "takeout", "folder")
MEDIA_TYPES = ("photo", "video", "audio", "document", "message")
CATEGORY_KINDS = ("place", "theme", "person", "custom")
PAGE_LIMIT, OFFSET_LIMIT, QUERY_CHARS = 200, 100_000, 512
TITLE_CHARS, DESCRIPTION_CHARS = 200, 4096
SNAPSHOT_IDS = 100_200

RECORD = ("sourceType string, mediaType string, originalPath string, mimeType string, date struct<value: timestamp, source: string>, "
          "author string, body string, gps struct<lat: double, lon: double, alt: double>, durationSec double, sourceRef string, sourceMeta string")
SKIP = "ref string, reason string, code string"

TABLES = {
    "sources": "id string, source_key string, type string, label string, original_path string, import_path string, imported_at timestamp",
    "items": ("id string, media_type string, title string, description string, search_meta string, capture_date string, capture_date_src string, "
              "gps_lat double, gps_lon double, duration_sec double, content_hash string, mime_type string, byte_size long, is_favourite boolean, "
              "thumb_status string, transcript_status string, embed_status string, category_status string, updated_at timestamp"),
    "item_occurrences": "id string, item_id string, source_id string, source_ref string, storage_mode string, stored_path string, source_meta string, created_at timestamp",
    "item_assets": "id string, item_id string, kind string, path string, width int, height int",
    "collections": "id string, name string, cover_item_id string, origin string, category_id string, created_at timestamp",
    "collection_items": "collection_id string, item_id string, position int, added_at timestamp",
    "transcripts": "item_id string, text string, language string, segments array<struct<start: double, end: double, text: string>>",
    "item_embeddings": "item_id string, model_id string, dim int, vector array<float>",
    "categories": "id string, kind string, name string, source_key string",
    "item_categories": "item_id string, category_id string, source string, state string, signal string, confidence double, explanation string",
}


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value, or an error naming it where it is not in the vocabulary."""
    bad = F.concat(F.lit("not allowed: "), F.coalesce(value, F.lit("null")))
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(bad).cast("string"))
