"""A catalog: a folder of versioned tables with a schema version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keepsake.log import Conflict, Log
from keepsake.schemas import SCHEMA_VERSION, TABLES


class Catalog:
    """Tables are written as new versions; the last entry of a log says which version of each counts.

    A version that a failed job left behind is in no entry, so it is never read. Of two writers of one table
    the later one gets a Conflict; writers of different tables do not hinder each other.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/_log")

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str | None = None) -> Catalog:
        """A new catalog; an error where there is one already."""
        made = cls(spark, root)
        try:
            made.log.append(1, {"schema": SCHEMA_VERSION, "name": name or "", "tables": {}})
        except Conflict as e:
            raise FileExistsError(root) from e
        for table, schema in TABLES.items():
            made.save(table, spark.createDataFrame([], schema))
        return made

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Catalog:
        """An existing catalog; an error where there is none or it is of a later schema."""
        found = cls(spark, root)
        number, state = found.log.newest()
        if not number:
            raise FileNotFoundError(root)
        version = state.get("schema")
        if version is None or version > SCHEMA_VERSION:
            raise ValueError(f"schema version {version}; this program knows up to {SCHEMA_VERSION}")
        for table, schema in TABLES.items():
            if not found.version(table):
                found.save(table, spark.createDataFrame([], schema))
        return found

    def _told(self, table: str) -> tuple[int, str | None]:
        return tuple(self.log.newest()[1].get("tables", {}).get(table, (0, None)))

    def version(self, table: str) -> int:
        return self._told(table)[0]

    def load(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{self._told(table)[1]}")

    def save(self, table: str, rows: DataFrame, expected: int | None = None) -> int:
        """Writes the next version and only then names it in the log.

        expected is the version that rows were made from (by default the one there is now); if the table has
        another by the time the rows are written, they are a Conflict.
        """
        before = self.version(table) if expected is None else expected
        folder = f"{table}/v={before + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        while True:
            number, state = self.log.newest()
            tables = state.get("tables", {})
            if tables.get(table, (0, None))[0] != before:
                raise Conflict(f"{table} is at version {tables[table][0]}, not {before}")
            try:
                self.log.append(number + 1, state | {"tables": tables | {table: (before + 1, folder)}})
                return before + 1
            except Conflict:  # another table's writer was first
                continue
