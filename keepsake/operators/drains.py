"""Runs over pending items, a page at a time: one at once, refused without what they need, ended between pages on demand."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.log import Conflict, Log
from keepsake.operators.graph import cut

#: Items of a page, and seconds after which a run that says nothing no longer keeps others out.
PAGE, LEASE_SECONDS = 10_000, 900.0


@dataclass
class Run:
    """outcome is busy, refused, cancelled, completed or idle; counts are items by status."""

    outcome: str
    reason: str | None = None
    counts: dict[str, int] = field(default_factory=dict)


class Drain:
    """Single-flight runs, over a log in the shared folder that names the run in progress."""

    def __init__(self, spark: SparkSession, folder: str, lease: float = LEASE_SECONDS, clock: Callable[[], float] = time.time):
        self.log, self.lease, self.clock = Log(spark, folder), lease, clock

    def _mark(self, run: str) -> bool:
        """Names the run as the one in progress, for another lease; False where another run is or comes between."""
        number, state = self.log.newest()
        own = state.get("run") == run
        if state.get("run") is not None and not own and state["until"] > self.clock():
            return False
        try:
            self.log.append(number + 1, {"run": run, "until": self.clock() + self.lease, "cancel": state.get("cancel") if own else None})
            return True
        except Conflict:
            return False

    def cancel(self) -> bool:
        """Asks the run in progress to end after its page; False where there is none."""
        while True:
            number, state = self.log.newest()
            if state.get("run") is None or state["until"] <= self.clock():
                return False
            try:
                self.log.append(number + 1, state | {"cancel": state["run"]})
                return True
            except Conflict:
                continue

    def run(self, pending: Callable[[], DataFrame], work: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], None],
            unavailable: Callable[[], str | None] = lambda: None, page: int = PAGE) -> Run:
        """Takes pending() items (id, ...) by id, `page` at a time, through work() (id, status, ...) and settle().

        A page is never taken twice, so a settle() that leaves items pending cannot make the run go round. What
        work() says of an item is its own; an error of a whole page is that page's alone if work() reports it
        by rows, and ends the run if it raises.
        """
        reason = unavailable()
        if reason:
            return Run("refused", reason)
        mine = uuid.uuid4().hex
        if not self._mark(mine):
            return Run("busy")
        counts: dict[str, int] = {}
        outcome = None
        try:
            after = None
            while outcome is None:
                rows = pending() if after is None else pending().filter(F.col("id") > F.lit(after))
                taken = cut(rows.orderBy("id").limit(page))
                last = taken.agg(F.max("id")).first()[0]
                if last is None:
                    break
                after = last
                if self.log.newest()[1].get("cancel") == mine:
                    outcome = "cancelled"
                    break
                done = cut(work(taken))
                settle(done)
                for r in done.groupBy("status").count().collect():
                    counts[r["status"]] = counts.get(r["status"], 0) + r["count"]
                while not self._mark(mine):
                    if self.log.newest()[1].get("run") != mine:
                        return Run("cancelled", "another run took over", counts)
        finally:
            self._end(mine)
        return Run(outcome or ("completed" if counts else "idle"), None, counts)

    def _end(self, mine: str) -> None:
        while True:
            number, state = self.log.newest()
            if state.get("run") != mine:
                return
            try:
                self.log.append(number + 1, {"run": None, "until": 0, "cancel": None})
                return
            except Conflict:
                continue


def transcribable_work(items: DataFrame, originals: DataFrame) -> DataFrame:
    """The pending audio and video items that have an original (item_id, stored_path) to read: with stored_path."""
    todo = items.filter(F.col("media_type").isin("audio", "video") & (F.col("transcript_status") == "pending"))
    return todo.join(originals.select(F.col("item_id").alias("id"), "stored_path"), "id").filter("stored_path is not null")
