"""Timeline: total order, keyset pages, month headers, opaque cursors."""

from __future__ import annotations

import base64
import binascii
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order(date: str = "capture_date", key: str = "id"):
    """Newest first, undated last, then by id descending."""
    return [F.col(date).desc_nulls_last(), F.col(key).desc()]


def page(items: DataFrame, limit: int, cursor: tuple[str | None, object] | None = None) -> DataFrame:
    """The rows after a cursor (capture_date or None, id); a filter and a top-k, never an offset."""
    if cursor:
        date, key = cursor
        if date is None:
            items = items.filter(F.col("capture_date").isNull() & (F.col("id") < F.lit(key)))
        else:
            items = items.filter((F.col("capture_date") < date) | ((F.col("capture_date") == date) & (F.col("id") < F.lit(key))) | F.col("capture_date").isNull())
    return items.orderBy(*order()).limit(limit)


def next_cursor(rows: list, limit: int) -> tuple[str | None, object] | None:
    """The cursor behind a page; None unless the page is full."""
    return (rows[-1]["capture_date"], rows[-1]["id"]) if len(rows) == limit else None


def encode_cursor(cursor: tuple[str | None, object]) -> str:
    return base64.urlsafe_b64encode(json.dumps({"captureDate": cursor[0], "id": cursor[1]}).encode()).decode().rstrip("=")


def decode_cursor(raw: str) -> tuple[str | None, object]:
    try:
        value = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
        date, key = value["captureDate"], value["id"]
    except (binascii.Error, ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if set(value) != {"captureDate", "id"} or not (date is None or isinstance(date, str)) or not isinstance(key, (str, int)) or isinstance(key, bool):
        raise ValueError("not a cursor")
    return date, key


def month_headers(items: DataFrame) -> DataFrame:
    """items with month ('yyyy-m', months from 0; 'undated') and is_header where it changes along the timeline.

    A header is the first row of its month, so it is found by one aggregation a month rather than by one
    global sort.
    """
    month = F.when(F.col("capture_date").isNull(), "undated").otherwise(
        F.concat_ws("-", F.substring("capture_date", 1, 4), (F.substring("capture_date", 6, 2).cast("int") - 1).cast("string")))
    keyed = items.withColumn("month", month)
    first = keyed.groupBy("month").agg(F.max(F.struct("capture_date", "id")).alias("_first")).select("month", F.col("_first.id").alias("_id"))
    return keyed.join(first, "month").withColumn("is_header", F.col("id") == F.col("_id")).drop("_id")


def ranked(rows: DataFrame, *by) -> DataFrame:
    """rank of a page's rows in its order; for results whose order is part of them, of bounded size."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*by)))
