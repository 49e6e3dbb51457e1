"""Vectorised text helpers and shared-folder helpers used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE_BASE = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1
_SPARK_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, and a lone surrogate becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def word_spans(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words (runs without ASCII white space) start and end."""
    if not buf:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = np.ones(len(buf) + 2, dtype=np.int8)
    space[1:-1] = _SPACE[np.frombuffer(buf, np.uint8)]
    step = np.diff(space)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, n.bit_length())
            self.up = np.full(size, self.base, np.uint64)
            self.down = np.full(size, self.inverse, np.uint64)
            for a in (self.up, self.down):
                a[0] = 1
                np.multiply.accumulate(a, out=a)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_SHINGLE_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), so that nearby sums become unrelated."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of one polynomial over the whole text."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _BYTE_POWERS.get(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((np.frombuffer(buf, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def char_hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As span_hashes, of spans of code points."""
    up, down = _BYTE_POWERS.get(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes; of the whole run if there are fewer, none if there is none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    up, down = _WORD_POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one is made only where the session names none and runs on one machine, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="keepsake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder from then on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many (narrow) rows, else for a join by shuffle, as Spark may take it for smaller than it is; df should be cut, as this counts them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def give_back() -> None:
    """Returns freed memory to the system, which a worker that lives on would keep; only glibc needs to be told."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: pa.Schema, rows: int = 256) -> DataFrame:
    """df.mapInPandas(run), where run is given so many rows at a time.

    An Arrow batch has up to 10,000 texts, which as strings and beside the next batch take several times its memory.
    """
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows).to_pandas(integer_object_nulls=True)
            del batch
            give_back()

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(slices(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return df.mapInArrow(arrow, ", ".join(f"{f.name} {_SPARK_TYPES[f.type]}" for f in schema))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
