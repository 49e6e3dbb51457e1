"""Zip archives as a data source: the directory at an archive's end is read first, then each entry's bytes by its own task."""

from __future__ import annotations

import functools
import glob
import os
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Limits of an archive: bytes of an entry and of all, entries, times its packed size.
ENTRY_BYTES, TOTAL_BYTES, ENTRIES, RATIO = 500_000_000, 2_000_000_000, 100_000, 100
#: A row holds so many bytes of an entry at most; small entries share a task up to as many.
PART_BYTES, TASK_BYTES = 16 << 20, 64 << 20
#: Archives whose directories the driver remembers.
REMEMBERED = 32
SCHEMA = "archive string, path string, size long, part int, content binary, code string"


def refusal(info: zipfile.ZipInfo, total: int, entry_bytes: int = ENTRY_BYTES, total_bytes: int = TOTAL_BYTES, ratio: int = RATIO) -> str | None:
    """Why an entry is not read, by what the directory says of it; total is what was taken before it."""
    name = info.filename.replace("\\", "/")
    if "\0" in info.orig_filename:
        return "E_NUL_NAME"
    if name.startswith("/") or name[1:3] == ":/" or ".." in name.split("/"):
        return "E_ZIP_SLIP"
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "E_SYMLINK"
    if info.flag_bits & 1:
        return "E_ENCRYPTED"
    if info.file_size > entry_bytes or total + info.file_size > total_bytes:
        return "E_TOO_LARGE"
    if info.file_size > ratio * max(1, info.compress_size):
        return "E_RATIO"
    return None


@dataclass
class Entries(InputPartition):
    """Entries of one archive that a task reads: (index in the directory, name, size); or rows that need no reading."""

    archive: str
    entries: list[tuple[int, str, int]]
    refused: list[tuple[str | None, int | None, str]]


class ZipReader(DataSourceReader):
    """The driver reads the directories alone, and refuses by them; a task seeks its entries in the archive."""

    def __init__(self, options: dict):
        # Spark does not keep the case of an option's name.
        told = {k.lower(): v for k, v in options.items()}
        self.path, number = told["path"], lambda k, d: int(told.get(k.lower(), d))
        self.limits = {"entry_bytes": number("entryBytes", ENTRY_BYTES), "total_bytes": number("totalBytes", TOTAL_BYTES), "ratio": number("ratio", RATIO)}
        self.most = number("entries", ENTRIES)

    def partitions(self) -> list[Entries]:
        out = []
        for archive in sorted(glob.glob(self.path)):
            try:
                with zipfile.ZipFile(archive) as z:
                    infos = z.infolist()
            except (zipfile.BadZipFile, OSError):
                out.append(Entries(archive, [], [(None, None, "E_BAD_ZIP")]))
                continue
            if len(infos) > self.most:
                out.append(Entries(archive, [], [(None, None, "E_TOO_MANY_ENTRIES")]))
                continue
            total, held, refused, some = 0, 0, [], []
            for i, info in enumerate(infos):
                if info.is_dir():
                    continue
                name, code = info.filename.replace("\\", "/"), refusal(info, total, **self.limits)
                if code:
                    refused.append((name, info.file_size, code))
                    continue
                total += info.file_size
                if some and held + info.file_size > TASK_BYTES:
                    out.append(Entries(archive, some, []))
                    some, held = [], 0
                some.append((i, name, info.file_size))
                held += info.file_size
            out.append(Entries(archive, some, refused))
        return out

    def read(self, partition: Entries) -> Iterator[tuple]:
        for name, size, code in partition.refused:
            yield partition.archive, name, size, None, None, code
        if not partition.entries:
            return
        with zipfile.ZipFile(partition.archive) as z:
            infos = z.infolist()
            for i, name, size in partition.entries:
                yield from _parts(z, infos[i], partition.archive, name, size)


def _parts(z: zipfile.ZipFile, info: zipfile.ZipInfo, archive: str, name: str, size: int) -> Iterator[tuple]:
    """An entry's bytes, a part at a time; an entry that is not what the directory says ends with a code."""
    done = part = 0
    try:
        with z.open(info) as f:
            while chunk := f.read(PART_BYTES):
                done += len(chunk)
                if done > size:  # more than was allowed for
                    raise ValueError("longer than told")
                yield archive, name, size, part, chunk, None
                part += 1
    except (zipfile.BadZipFile, zlib.error, ValueError, EOFError, OSError, NotImplementedError, RuntimeError):
        yield archive, name, size, part, None, "E_BAD_ENTRY"
        return
    if not part:
        yield archive, name, size, 0, b"", None


class ZipEntries(DataSource):
    """spark.read.format("zipentries").load(path): rows of SCHEMA; refused entries have a code and no content."""

    @classmethod
    def name(cls) -> str:
        return "zipentries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def entries(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """Rows of SCHEMA for the archives that a path or pattern names, on a folder that driver and executors see."""
    spark.dataSource.register(ZipEntries)
    reader = spark.read.format("zipentries")
    for name, value in limits.items():
        reader = reader.option(name, str(value))
    return reader.load(path.removeprefix("file://"))


def unzip(spark: SparkSession, path: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(parts (archive, path, size, part, content), skips) of zip archives.

    An entry of up to PART_BYTES is one part. Refused are entries that leave the archive, are links, encrypted,
    too large or packed too tightly, by the directory and before a byte is unpacked; and those whose bytes are
    not what it says, of which no part is given.
    """
    found = entries(spark, path, **limits)
    bad = found.filter("code is not null")
    spoilt = bad.filter("code = 'E_BAD_ENTRY'").select("archive", "path").distinct()
    kept = found.filter("code is null").join(F.broadcast(spoilt), ["archive", "path"], "left_anti").select("archive", "path", "size", "part", "content")
    return kept, bad.select(F.concat_ws("!", "archive", "path").alias("ref"), F.lit("archive entry refused").alias("reason"), "code")


@functools.lru_cache(maxsize=REMEMBERED)
def _names(path: str, changed: int, size: int) -> tuple[str, ...]:
    try:
        with zipfile.ZipFile(path) as z:
            return tuple(z.namelist())
    except (zipfile.BadZipFile, OSError):
        return ()


def names(path: str) -> tuple[str, ...]:
    """The entries that an archive's directory names, none if it is no archive; remembered while the file stays as it is."""
    at = os.stat(path)
    return _names(path, at.st_mtime_ns, at.st_size)


def has_entry(path: str, markers: tuple[str, ...]) -> bool:
    """Does a zip archive that the driver can open name an entry with one of the markers?"""
    return any(m in n for n in names(path) for m in markers)
