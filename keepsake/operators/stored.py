"""A stored inverted index: postings in files sorted by token, in segments that are added to, masked and merged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.log import Log
from keepsake.operators.graph import cut
from keepsake.operators.search import postings

#: Bytes of a row group: a search reads those whose range of tokens it asks for.
ROW_GROUP = 1 << 20
_POSTINGS, _SIZES, _GONE = "token string, id {0}, places array<int>, n long", "id {0}, length long", "id {0}"


class StoredIndex:
    """Segments of postings under a folder, and a log of which of them count.

    A segment holds the items that were added together, sorted by token and cut into small row groups, so that a
    token or a prefix is found by the groups' ranges; its `gone` ids hide what older segments say of them. A
    segment counts from the moment in which the log names it; of two writers at once one gets a Conflict. Each
    segment has a dictionary of its tokens with how many items have them.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long"):
        self.spark, self.folder, self.id_type, self.log = spark, folder.rstrip("/"), id_type, Log(spark, f"{folder.rstrip('/')}/_log")

    def segments(self) -> list[str]:
        return self.log.newest()[1].get("segments", [])

    def _write(self, rows: DataFrame, sizes: DataFrame, gone: DataFrame) -> str:
        name = f"{self.folder}/segment-{uuid.uuid4().hex}"
        sorted_rows = rows.select("token", "id", "places", "n").repartitionByRange("token", "id").sortWithinPartitions("token", "id")
        sorted_rows.write.option("parquet.block.size", ROW_GROUP).parquet(f"{name}/postings")
        sizes.write.parquet(f"{name}/sizes")
        gone.distinct().write.parquet(f"{name}/gone")
        words = self._read(name, "postings").groupBy("token").agg(F.count("*").alias("items"), F.sum("n").alias("n"))
        words.repartitionByRange("token").sortWithinPartitions("token").write.option("parquet.block.size", ROW_GROUP).parquet(f"{name}/terms")
        return name

    def _read(self, segment: str, what: str) -> DataFrame:
        schema = {"postings": _POSTINGS, "sizes": _SIZES, "gone": _GONE, "terms": "token string, items long, n long"}[what]
        return self.spark.read.schema(schema.format(self.id_type)).parquet(f"{segment}/{what}")

    def add(self, changed: DataFrame, deleted: DataFrame | None = None) -> None:
        """A new segment of `changed` items (new, or written anew), which hides their older rows and those of `deleted` ids."""
        number, state = self.log.newest()
        ids = changed.select("id") if deleted is None else changed.select("id").unionByName(deleted.select("id"))
        # Postings are made once, and sizes from them; the bounds of the files are found by a pass over them.
        rows = cut(postings(changed))
        sizes = changed.select("id").distinct().join(rows.groupBy("id").agg(F.sum("n").alias("length")), "id", "left")
        made = self._write(rows, sizes.select("id", F.coalesce("length", F.lit(0)).alias("length")), ids)
        self.log.append(number + 1, {"segments": [*state.get("segments", []), made]})

    def _live(self, what: str) -> DataFrame:
        """The rows of all segments that no later one hides. A filter on the token goes down to every segment's files."""
        every = self.segments()
        if not every:
            schema = {"postings": _POSTINGS, "sizes": _SIZES}[what]
            return self.spark.createDataFrame([], schema.format(self.id_type))
        live = None
        for i, segment in enumerate(every):
            rows = self._read(segment, what)
            later = every[i + 1:]
            if later:
                hidden = self._read(later[0], "gone")
                for s in later[1:]:
                    hidden = hidden.unionByName(self._read(s, "gone"))
                rows = rows.join(hidden, "id", "left_anti")
            live = rows if live is None else live.unionByName(rows)
        return live

    def postings(self) -> DataFrame:
        return self._live("postings")

    def sizes(self) -> DataFrame:
        return self._live("sizes")

    def terms(self, prefix: str) -> DataFrame:
        """(token, items, n): the tokens that begin so, from the dictionaries; rows of hidden items still count until a merge."""
        every = [self._read(s, "terms").filter(F.col("token").startswith(prefix)) for s in self.segments()]
        if not every:
            return self.spark.createDataFrame([], "token string, items long, n long")
        found = every[0]
        for more in every[1:]:
            found = found.unionByName(more)
        return found.groupBy("token").agg(F.sum("items").alias("items"), F.sum("n").alias("n"))

    def merge(self) -> None:
        """One segment in place of all, without what was hidden; an index that changed meanwhile is a Conflict."""
        number, state = self.log.newest()
        if len(state.get("segments", [])) > 1:
            made = self._write(self.postings(), self.sizes(), self.sizes().select("id").limit(0))
            self.log.append(number + 1, {"segments": [made]})
