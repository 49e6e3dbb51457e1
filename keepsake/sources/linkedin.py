"""LinkedIn CSV files: RFC 4180, a header somewhere below a preamble, columns by several names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.dates import linkedin_date
from keepsake.sources.records import dated, nonempty, records, skips

# Columns by which a file's header is known, and the names each field goes by.
HEADERS = {"messages.csv": ("content", "from", "date"), "connections.csv": ("first name", "last name", "connected on"), "rich_media.csv": ("media link", "link", "media url")}


def parse_csv(text: str) -> list[list[str]]:
    """Rows of an RFC 4180 text; CR, LF and CRLF end rows. A NUL or an open quote is an error."""
    if text.startswith("﻿"):
        text = text[1:]
    if "\0" in text:
        raise ValueError("NUL in CSV")
    rows, row, at, n = [], [], 0, len(text)
    while at < n:
        if text[at] == '"':
            cell, at = [], at + 1
            while True:
                end = text.find('"', at)
                if end < 0:
                    raise ValueError("unterminated quote")
                cell.append(text[at:end])
                at = end + 1
                if text[at:at + 1] != '"':
                    break
                cell.append('"')
                at += 1
            value = "".join(cell)
        else:
            value = ""
        end = at
        while end < n and text[end] not in ",\r\n":
            end += 1
        row.append(value + text[at:end])
        at = end
        if at < n and text[at] == ",":
            at += 1
            if at == n:
                row.append("")
            continue
        if at < n:
            at += 2 if text[at:at + 2] == "\r\n" else 1
        rows.append(row)
        row = []
    return rows + ([row] if row else [])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text), whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def rows(files: DataFrame) -> DataFrame:
    """(file, kind, row, cells map, problem) of the known files; row counts from the file's first row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                kind = file.rsplit("/", 1)[-1].lower()
                if kind not in HEADERS:
                    continue
                try:
                    parsed = parse_csv(text or "")
                except ValueError as e:
                    out.append((file, kind, -1, None, str(e)))
                    continue
                names = [[" ".join(c.strip().lower().split()) for c in r] for r in parsed]
                top = next((i for i, r in enumerate(names) if any(h in r for h in HEADERS[kind])), None)
                if top is None:
                    out.append((file, kind, -1, None, "no recognizable header row"))
                    continue
                for i, r in enumerate(parsed[top + 1:], top + 1):
                    cells = {}
                    for name, cell in zip(names[top], r, strict=False):
                        if name and name not in cells:
                            cells[name] = cell.strip()
                    out.append((file, kind, i, cells, None))
            yield pd.DataFrame(out, columns=["file", "kind", "row", "cells", "problem"])

    return files.mapInPandas(run, "file string, kind string, row int, cells map<string, string>, problem string")


def _cell(*names: str) -> Column:
    return F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names], F.lit(""))


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, skips): messages, connections and rich media; rows without any of their main fields are skipped."""
    parsed = rows(files)
    ref = F.concat(F.substring_index("file", "/", -1), F.lit("#"), F.col("row").cast("string"))
    good, bad = parsed.filter("problem is null"), parsed.filter("problem is not null")
    message, link = F.col("kind") == "messages.csv", F.col("kind") == "rich_media.csv"
    person = F.trim(F.concat(_cell("first name"), F.lit(" "), _cell("last name")))
    company, position = _cell("company"), _cell("position")
    job = F.when((position != "") & (company != ""), F.concat(position, F.lit(" at "), company)).otherwise(F.coalesce(nonempty(position), nonempty(company)))
    when = F.when(message, _cell("date", "time")).when(link, _cell("time", "date")).otherwise(_cell("connected on"))
    author = F.when(message, _cell("from", "sender")).when(~link, person)
    body = F.when(message, nonempty(_cell("content", "message", "body"))).when(link, nonempty(_cell("media link", "link", "media url"))).otherwise(job)
    empty = (when == "") & body.isNull() & (F.coalesce(author, F.lit("")) == "")
    meta = F.struct(F.when(message, "message").when(link, "rich_media").otherwise("connection").alias("kind"), nonempty(_cell("subject")).alias("subject"), nonempty(_cell("to", "recipient")).alias("to"),
                    nonempty(_cell("conversation id")).alias("conversationId"), nonempty(_cell("conversation title")).alias("conversationTitle"), nonempty(_cell("folder")).alias("folder"),
                    nonempty(company).alias("company"), nonempty(position).alias("position"), nonempty(_cell("url", "profile url")).alias("profileUrl"))
    kept = records(good.filter(~empty), sourceType=F.lit("linkedin"), mediaType=F.lit("message"), date=dated(linkedin_date(when)), author=nonempty(author), body=body, sourceRef=ref, sourceMeta=meta)
    return kept, skips(good.filter(empty), ref, "row is empty", "E_PARSE").union(bad.select(F.substring_index("file", "/", -1).alias("ref"), F.col("problem").alias("reason"), F.lit("E_PARSE").alias("code")))
