"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set, a temporary folder serves a session of one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="keepsake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as tasks run at once, where it comes from fewer files than that.

    A file of one row group is read by one task, however it is split; work that costs more than a shuffle of what it works on
    is better dealt out. A table of many files stays as it is.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if 0 < len(df.inputFiles()) < tasks else df


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) for nodes (id) and edges (a, b): the smallest id that each node reaches.

    A round gives each node the least label of its neighbours and then the label of that label, so chains
    shorten by half; it ends when nothing changes.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct())
    now = cut(nodes.select("id", F.col("id").alias("root")).distinct())
    while True:
        near = both.join(now.select(F.col("id").alias("v"), "root"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near"))
        step = now.join(near, "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        nxt = cut(step.join(jump, "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root")))
        moved = nxt.join(now.withColumnRenamed("root", "old"), "id").filter("root <> old").limit(1).count()
        now = nxt
        if not moved:
            return now
