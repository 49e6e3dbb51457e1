"""The record every source makes, and what it skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPES = {"sourceType": "string", "mediaType": "string", "originalPath": "string", "mimeType": "string", "date": "struct<value: timestamp, source: string>", "author": "string",
          "body": "string", "gps": "struct<lat: double, lon: double, alt: double>", "durationSec": "double", "sourceRef": "string", "sourceMeta": "string"}


def dated(value: Column, source: str = "message") -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source")))


def nonempty(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def records(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows as records; what is not given is null. sourceMeta may be given as a struct."""
    made = []
    for name, kind in _TYPES.items():
        value = columns.get(name, F.lit(None))
        made.append((F.to_json(value) if name == "sourceMeta" and name in columns else value.cast(kind)).alias(name))
    return rows.select(*made)


def skips(rows: DataFrame, ref: Column, reason: str, code: str) -> DataFrame:
    return rows.select(ref.alias("ref"), F.lit(reason).alias("reason"), F.lit(code).alias("code"))
