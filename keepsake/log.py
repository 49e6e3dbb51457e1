"""A log of numbered entries in a shared folder, of which only one writer can make each."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made the entry first."""


class Log:
    """Entries 1, 2, ... as files. An entry is written whole under another name and then renamed, which fails where it exists."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _file(self, number: int) -> str:
        return f"{number:012d}.json"

    def last(self) -> int:
        """The number of the newest entry; 0 where there is none."""
        top = self._path()
        fs = top.getFileSystem(self._conf)
        if not fs.exists(top):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, number: int) -> dict:
        path = self._path(self._file(number))
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict]:
        """The newest entry with its number; (0, {}) where there is none."""
        number = self.last()
        return number, self.read(number) if number else {}

    def append(self, number: int, entry: dict) -> None:
        """Makes entry `number`; a Conflict where it exists already."""
        temporary, path = self._path(f".{uuid.uuid4().hex}.tmp"), self._path(self._file(number))
        fs = path.getFileSystem(self._conf)
        out = fs.create(temporary, False)
        try:
            out.write(json.dumps(entry, sort_keys=True).encode())
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(path), none)
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"{self.folder}: entry {number} exists") from e
            raise
