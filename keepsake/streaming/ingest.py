"""Streaming ingestion: batches of records merged into a bucketed table of items, safe to replay."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keepsake.log import Log
from keepsake.operators.graph import cut
from keepsake.operators.merge import upsert_items


def item_rows(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Records as item rows with their content hash and order of arrival."""
    return records.select(F.sha2(F.coalesce("body", F.lit("")), 256).alias("id"), F.col("mediaType").alias("media_type"), F.col("body").alias("description"),
                          F.concat_ws(" ", F.substring_index("originalPath", "/", -1), "author").alias("search_meta"),
                          F.date_format("date.value", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("capture_date"), F.when(F.col("body").isNotNull(), F.sha2("body", 256)).alias("content_hash"), F.col(seq).alias("seq"))


#: Buckets that the items are kept in. A batch reads and writes those that its own items belong to.
BUCKETS = 64
_ITEM = ("id", "media_type", "description", "search_meta", "capture_date", "content_hash")
_SCHEMA = ", ".join(f"{c} string" for c in _ITEM)


def _bucket(buckets: int) -> Column:
    """Of an item's hash, which decides what it is merged with; of its id where it has none and is merged with nothing."""
    return F.pmod(F.xxhash64(F.coalesce("content_hash", "id")), F.lit(buckets)).cast("int")


def merge_batch(folder: str, make: Callable[[DataFrame], DataFrame] = lambda x: x, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the buckets that a batch touches are read, merged with it and written anew.

    A log entry names the files of each bucket and the last batch, and is made only after the files; so a batch
    that is run again after its entry does nothing, and files of one that failed are never read. Of two writers
    that merge at once one gets a Conflict and has to run its batch again. The number of buckets is fixed by the first batch.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = Log(spark, f"{folder}/_log")
        entry, state = log.newest()
        if number <= state.get("batch", -1):
            return
        files, n = dict(state.get("files", {})), state.get("buckets", buckets)
        new = cut(make(batch).select(*_ITEM, "seq").withColumn("bucket", _bucket(n)))
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        old = [files[str(b)] for b in touched if str(b) in files]
        rows = new.withColumn("seq", F.col("seq").cast("long"))
        apart = new.filter("content_hash is null").select(*_ITEM)
        if old:
            known = spark.read.schema(_SCHEMA).parquet(*[f"{folder}/{f}" for f in old])
            rows = known.withColumns({"seq": F.lit(-1 << 62), "bucket": F.lit(0)}).unionByName(rows)
            apart = known.filter("content_hash is null").unionByName(apart)
        merged = upsert_items(rows.filter("content_hash is not null").drop("bucket"), ("description", "capture_date")).select(*_ITEM).unionByName(apart)
        made = f"data/batch-{number}-{uuid.uuid4().hex}"
        if touched:
            merged.withColumn("bucket", _bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{made}")
        log.append(entry + 1, {"batch": number, "buckets": n, "touched": touched, "files": files | {str(b): f"{made}/bucket={b}" for b in touched}})

    return run


def ingest(spark: SparkSession, path: str, schema: str, folder: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], files_per_batch: int = 1, buckets: int = BUCKETS) -> StreamingQuery:
    """Takes what is new under path, and ends; started again with the same checkpoint it goes on where it was."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge_batch(folder, make, buckets)).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The items as of the last batch."""
    files = Log(spark, f"{folder}/_log").newest()[1].get("files", {})
    if not files:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(*[f"{folder}/{files[b]}" for b in sorted(files, key=int)])


def activity(events: DataFrame, window: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Events a type and window, for streams (behind a watermark) and tables alike."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
