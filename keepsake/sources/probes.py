"""What files say of themselves: EXIF dates and places, lengths and sizes of media."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.sources.containers import container, measure

# Fixed values of EXIF: tags, and bytes of each type.
_TAKEN, _CHANGED, _EXIF, _GPS, _ORIENTATION = 0x9003, 0x0132, 0x8769, 0x8825, 0x0112
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tags(data: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    """Tag to (type, count, raw value) of the directory at an offset."""
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size, where = _SIZES.get(kind, 1) * count, at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        found[tag] = (kind, count, data[where:where + size])
    return found


def _fractions(raw: bytes, order: str) -> list[float]:
    numbers = struct.unpack(f"{order}{len(raw) // 4}I", raw)
    return [a / b if b else float("nan") for a, b in zip(numbers[::2], numbers[1::2], strict=True)]


def read_exif(content: bytes) -> dict | None:
    """taken (a wall clock read as UTC), lat, lon, orientation of a JPEG; None if it says none of them. Never fails."""
    try:
        at = content.find(b"Exif\0\0")
        if at < 0:
            return None
        data = content[at + 6:]
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        top = _tags(data, struct.unpack_from(order + "I", data, 4)[0], order)
        sub = _tags(data, struct.unpack(order + "I", top[_EXIF][2])[0], order) if _EXIF in top else {}
        out = {"taken": None, "lat": None, "lon": None, "orientation": None}
        stamp = sub.get(_TAKEN) or top.get(_CHANGED)
        if stamp:
            try:
                out["taken"] = dt.datetime.strptime(stamp[2].split(b"\0")[0].decode("ascii", "replace").strip(), "%Y:%m:%d %H:%M:%S")
            except ValueError:
                pass
        if _ORIENTATION in top:
            (out["orientation"],) = struct.unpack_from(order + "H", top[_ORIENTATION][2])
        if _GPS in top:
            gps = _tags(data, struct.unpack(order + "I", top[_GPS][2])[0], order)
            if all(t in gps for t in (1, 2, 3, 4)):
                place = []
                for mark, value, negative in ((1, 2, b"S"), (3, 4, b"W")):
                    d, m, s = _fractions(gps[value][2], order)[:3]
                    place.append((d + m / 60 + s / 3600) * (-1 if gps[mark][2][:1].upper() == negative else 1))
                if all(x == x for x in place) and abs(place[0]) <= 90 and abs(place[1]) <= 180:
                    out["lat"], out["lon"] = place
        return out if any(v is not None for v in out.values()) else None
    except (struct.error, KeyError, ValueError, IndexError):
        return None


def wav_seconds(content: bytes) -> float | None:
    """Length of a RIFF WAVE file from its chunks; None for anything else."""
    return measure(content)["seconds"] if container(content) == "wav" else None


def real_time_factor(audio: DataFrame, took: DataFrame) -> DataFrame:
    """(id, seconds, rtf): the time that recognition took (id, ms) over the length of the audio (id, seconds); null where that is unknown or none."""
    joined = took.join(audio.select("id", "seconds"), "id", "left")
    return joined.select("id", "seconds", (F.col("ms") / 1000.0 / F.nullif("seconds", F.lit(0.0))).alias("rtf"))


#: Files are read whole by the task that probes them; larger ones are not probed.
PROBE_BYTES = 1 << 30


def probe(spark: SparkSession, path: str) -> DataFrame:
    """(path, taken, lat, lon, orientation, container, seconds, width, height) of the files below a folder; nulls where a file says nothing."""
    columns = ["path", "taken", "lat", "lon", "orientation", "container", "seconds", "width", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                e, m = read_exif(bytes(content)) or {}, measure(bytes(content))
                rows.append((name, e.get("taken"), e.get("lat"), e.get("lon"), e.get("orientation"), m["container"], m["seconds"], m["width"], m["height"]))
            yield pd.DataFrame(rows, columns=columns).astype({"orientation": "Int32", "taken": "datetime64[us]", "seconds": "float64", "width": "Int32", "height": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= PROBE_BYTES).select("path", "content")
    return files.mapInPandas(run, "path string, taken timestamp, lat double, lon double, orientation int, container string, seconds double, width int, height int")
