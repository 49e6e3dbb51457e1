"""Originals by content: copied, hashed and checked by the tasks, each content once, whoever brings it."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes copied at a time; characters of an extension, its dot included.
CHUNK, EXT_CHARS = 1 << 20, 16
_PUT = "path string, content_hash string, ext string, stored_path string, copied boolean, code string"


def stored_path(content_hash: str, ext: str | None) -> str:
    """originals/<first two>/<hash><ext>; an error for what is no hash or no plain extension."""
    if not re.fullmatch("[0-9a-f]{64}", content_hash):
        raise ValueError("E_PATH_ESCAPE")
    ext = "" if not ext else ext if ext.startswith(".") else f".{ext}"
    if ext and (len(ext) > EXT_CHARS or not re.fullmatch(r"\.[A-Za-z0-9]+", ext)):
        raise ValueError("E_PATH_ESCAPE")
    return f"originals/{content_hash[:2]}/{content_hash}{ext}"


def digest(path: str) -> str:
    made = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            made.update(chunk)
    return made.hexdigest()


def put_one(root: str, source: str, ext: str | None, expected: str | None = None) -> tuple[str | None, str | None, bool, str | None]:
    """(hash, stored path, copied, code): source's bytes under their hash below root.

    They are hashed as they are copied into a file of their own beside the place; the file gets its name by a
    link, which fails where the name is taken, so of any number of writers one makes it and nobody sees a part.
    A blob that is there already is read again, and replaced if it is not what its name says.
    """
    folder = os.path.join(root, "originals")
    os.makedirs(folder, exist_ok=True)
    temporary, made = os.path.join(folder, f".{uuid.uuid4().hex}.tmp"), hashlib.sha256()
    try:
        with open(source, "rb") as f, open(temporary, "xb") as out:
            while chunk := f.read(CHUNK):
                made.update(chunk)
                out.write(chunk)
            out.flush()
            os.fsync(out.fileno())
        found = made.hexdigest()
        if expected is not None and found != expected:
            return found, None, False, "E_INTEGRITY"
        relative = stored_path(found, ext)
        place = os.path.join(root, relative)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        try:
            os.link(temporary, place)
        except FileExistsError:
            if digest(place) == found:
                return found, relative, False, None
            os.replace(temporary, place)
        return found, relative, True, None
    except OSError as e:
        return None, None, False, "E_NOT_FOUND" if isinstance(e, FileNotFoundError) else "E_IO"
    except ValueError as e:
        return None, None, False, str(e)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temporary)


def put(files: DataFrame, root: str) -> DataFrame:
    """_PUT rows for files (path, ext, expected): expected hashes may be null. root and the paths are on a folder that all executors see.

    A file whose task runs twice is stored once; the second run says that it copied nothing.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ext, expected in zip(batch["path"], batch["ext"], batch["expected"], strict=True):
                found, relative, copied, code = put_one(root, path, ext, expected)
                rows.append((path, found, ext, relative, copied, code))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "ext", "stored_path", "copied", "code"])

    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "ext", "expected").mapInPandas(run, _PUT)


def verify(blobs: DataFrame, root: str) -> DataFrame:
    """(content_hash, ext, ok): is each blob (content_hash, ext) there, and what its name says?"""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for content_hash, ext in zip(batch["content_hash"], batch["ext"], strict=True):
                try:
                    ok.append(digest(os.path.join(root, stored_path(content_hash, ext))) == content_hash)
                except (OSError, ValueError):
                    ok.append(False)
            yield batch.assign(ok=ok)

    return blobs.select("content_hash", "ext").mapInPandas(run, "content_hash string, ext string, ok boolean")


def remove(blobs: DataFrame, root: str) -> DataFrame:
    """(content_hash, ext, removed): takes out blobs that nothing refers to; one that is gone already counts as removed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = []
            for content_hash, ext in zip(batch["content_hash"], batch["ext"], strict=True):
                try:
                    with contextlib.suppress(FileNotFoundError):
                        os.unlink(os.path.join(root, stored_path(content_hash, ext)))
                    gone.append(True)
                except (OSError, ValueError):
                    gone.append(False)
            yield batch.assign(removed=gone)

    return blobs.select("content_hash", "ext").mapInPandas(run, "content_hash string, ext string, removed boolean")
