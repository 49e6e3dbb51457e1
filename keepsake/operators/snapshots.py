"""Search results frozen for paging: the newest few are kept under tokens, and an unknown token starts anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.log import Conflict, Log
from keepsake.schemas import SNAPSHOT_IDS

#: Snapshots that are kept; the one unused for longest goes first.
KEPT = 8


@dataclass
class Page:
    """A page (pos, then the items' columns), the token for the next one, how many hits there are, and whether the search was run for it."""

    rows: DataFrame
    token: str
    total: int
    fresh: bool


class Snapshots:
    """Frozen orders of ids below a folder, and a log of which count, the newest used last."""

    def __init__(self, spark: SparkSession, folder: str, kept: int = KEPT, most_ids: int = SNAPSHOT_IDS):
        self.spark, self.folder, self.kept, self.most_ids = spark, folder.rstrip("/"), kept, most_ids
        self.log = Log(spark, f"{self.folder}/_log")

    def tokens(self) -> list[str]:
        return [t for t, _ in self.log.newest()[1].get("kept", [])]

    def _use(self, token: str, total: int) -> None:
        """Makes a token the newest used one; what is beyond the number kept is forgotten and its files go."""
        while True:
            number, state = self.log.newest()
            now = [x for x in state.get("kept", []) if x[0] != token] + [[token, total]]
            try:
                self.log.append(number + 1, {"kept": now[-self.kept:]})
            except Conflict:  # another session used one meanwhile
                continue
            for old, _ in now[:-self.kept]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            return

    def freeze(self, hits: DataFrame, by: list[Column]) -> str:
        """A token for hits (id and what `by` names) in their order; of more than most_ids the first."""
        token = uuid.uuid4().hex
        top = hits.orderBy(*by).limit(self.most_ids)
        # A bounded number of ids is numbered.
        numbered = top.select((F.row_number().over(Window.orderBy(*by)) - 1).alias("pos"), "id")
        numbered.write.parquet(f"{self.folder}/{token}")
        self._use(token, hits.count())
        return token

    def page(self, items: DataFrame, offset: int, limit: int, search: Callable[[], tuple[DataFrame, list[Column]]], token: str | None = None) -> Page:
        """Rows `offset` to `offset + limit` of the snapshot, with the items as they are now and whatever filters they would pass now.

        Without a token, or with one that is not kept any more, search() gives the hits and their order, which are
        frozen first. Items that are gone have no row; new ones change nothing.
        """
        known = dict(self.log.newest()[1].get("kept", []))
        fresh = token not in known
        if fresh:
            token = self.freeze(*search())
            known = dict(self.log.newest()[1]["kept"])
        else:
            self._use(token, known[token])
        part = self.spark.read.parquet(f"{self.folder}/{token}").filter(F.col("pos").between(offset, offset + limit - 1))
        return Page(F.broadcast(part).join(items, "id").orderBy("pos"), token, known[token], fresh)
