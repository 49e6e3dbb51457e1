"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import broadcast_up_to, cut, fresh, partitions

MAX_COPIES = 3
#: Rows of one source that are rounded together; sources are cut into as many parts as they have of these.
PART_ROWS = 2_000
TOLERANCE = 1e-6
MAX_ROUNDS = 60
#: Sums in this type don't depend on the order of their terms, so reruns give the same rates.
EXACT = "decimal(38,9)"
#: Up to so many sources, what is known of each is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size): words of each text, 0 for null."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size"))


def targets(per_source: DataFrame, max_ratio: float = MAX_COPIES) -> DataFrame:
    """per_source (source, total, weight) with target: shares of all totals by weight, at most max_ratio times a total.

    The excess of capped sources is shared again by weight until none is above its cap. Capping raises the
    share of each unit of weight, so the capped sources are those whose total per weight is smallest: sorted
    by it, source j is capped if what is left after the caps before it, per weight left, still exceeds its
    cap. One row a source goes through one window, whatever the number of documents is.
    """
    w = Window.orderBy((F.col("total") / F.col("weight")), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = per_source.select(
        "*",
        (F.sum("total").over(whole) - max_ratio * F.coalesce(F.sum("total").over(before), F.lit(0))).alias("_left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weight"))
    level = F.col("_left").cast("double") / F.col("_weight")
    capped = level * F.col("weight") > max_ratio * F.col("total")
    # All after the first uncapped source share its level.
    flagged = ranked.withColumn("_level", F.when(~capped, level)).withColumn("_level", F.first("_level", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("_level").isNull(), (max_ratio * F.col("total")).cast("double")).otherwise(F.col("_level") * F.col("weight"))
    return flagged.withColumn("target", target).drop("_left", "_weight", "_level")


def _rate(size, tilt, mean, most):
    """exp(tilt * size / mean), at most `most`: the rate that keeps the relative entropy to "every document once" least."""
    return F.least(F.exp(F.least(F.col(tilt) * F.col(size) / F.col(mean), F.lit(50.0))), F.lit(float(most)))


def balance(sized: DataFrame, goals: DataFrame, most: float = MAX_COPIES) -> DataFrame:
    """goals (source, total, target, ...) with tilt and mean: the dual solution of each source's token constraint.

    Rates w minimise the entropy sum of w ln w - w + 1 over documents, subject to each source's
    sum of w * size = target and w <= most; the dual is convex and separates by source, and its optimum
    has w = min(most, exp(tilt * size / mean)). Each Newton round is one distributed aggregation of gradient
    and curvature over a histogram of (source, size); a bracket keeps the steps safe where rates are capped.
    """
    hist = cut(sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    state = cut(goals.withColumn("mean", F.col("mean").cast("double")).select(
        "source", "target", "mean", "total", F.lit(0.0).alias("tilt"), F.lit(-1e3).alias("lo"), F.lit(1e6).alias("hi"),
        (F.col("target") >= most * F.col("total")).alias("full")))
    for _ in range(MAX_ROUNDS):
        rate = _rate("size", "tilt", "mean", most)
        tokens = F.col("n") * F.col("size") * rate
        now = state.select(F.col("source").alias("_s"), "tilt", "mean")
        sums = (hist.join(now, F.col("source").eqNullSafe(F.col("_s")))
                .groupBy("_s").agg(
                    F.sum(tokens.cast(EXACT)).cast("double").alias("got"),
                    F.sum(F.when(rate < most, tokens * F.col("size") / F.col("mean")).otherwise(0.0).cast(EXACT)).cast("double").alias("slope")))
        gap = F.col("got") - F.col("target")
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        lo = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        middle = F.when(hi >= 1e6, F.greatest(F.col("tilt") * 4, F.lit(1.0))).when(lo <= -1e3, F.least(F.col("tilt") * 4, F.lit(-1.0))).otherwise((lo + hi) / 2)
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise(middle)
        off = F.when(F.col("full") | F.col("got").isNull(), F.lit(0.0)).otherwise(F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0)))
        state = cut(joined.select("source", "target", "mean", "total", F.when(off < TOLERANCE, F.col("tilt")).otherwise(step).alias("tilt"),
                                  lo.alias("lo"), hi.alias("hi"), "full", off.alias("off")))
        worst = state.agg(F.max("off")).first()[0]
        state = state.drop("off")
        if worst is None or worst < TOLERANCE:
            break
    return state


def _round(most: int):
    """Error diffusion in each (source, part), long documents first: what one document is rounded by, the next make good."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, due = None, 0.0
        for batch in batches:
            copies = np.zeros(len(batch), np.int64)
            columns = [batch[c].tolist() for c in ("group", "size", "rate")]
            for i, (group, size, rate) in enumerate(zip(*columns, strict=True)):
                if group != key:
                    key, due = group, 0.0
                due += size * rate
                if size:
                    n = min(max(int(np.floor(rate)), min(int(np.ceil(rate)), int(np.floor(due / size + 0.5)))), most)
                    copies[i] = n
                    due -= n * size
            yield batch[["id", "source", "size"]].assign(copies=copies)
    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        most: int = MAX_COPIES, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of docs.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A text's size is its number of words; null,
    empty and white-space texts have size 0 and no copies. Copies are a document's rate rounded down or up.
    A source is rounded in parts of about `part_rows` rows, chosen by a hash of the id, so no source meets in
    one task; repeated rows are rounded one by one. An empty table gives an empty result. Reruns agree.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("rows"),
                                             F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = cut(per_source.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1))
    goals = cut(targets(weighed, most))
    state = balance(sized, goals, most).select(F.col("source").alias("_s"), "tilt", F.col("mean").alias("_mean"), "full", F.col("target"))
    rows = weighed.select(F.col("source").alias("_w"), "rows", "total")
    params = broadcast_up_to(cut(state.join(rows, F.col("_s").eqNullSafe(F.col("_w"))).drop("_w")), BROADCAST_SOURCES)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), F.lit(float(most))).otherwise(_rate("size", "tilt", "_mean", most))
    part = F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("rows") / part_rows).cast("long"))
    dealt = (sized.join(params, F.col("source").eqNullSafe(F.col("_s")))
             .select("id", "source", "size", rate.alias("rate"), F.xxhash64("source", part).alias("group")))
    n = partitions(docs.sparkSession)
    rounded = (dealt.repartition(n, "group").sortWithinPartitions("group", F.col("size").desc(), F.col("id").asc_nulls_last())
               .mapInPandas(_round(most), "id long, source string, size long, copies long"))
    named = params.select("_s", F.col("total").alias("source_size"), "target")
    return rounded.join(named, F.col("source").eqNullSafe(F.col("_s"))).select("id", "source", "size", "source_size", "target", "copies")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MAX_COPIES) -> DataFrame:
    """docs with each row as often as the mix takes it; columns unchanged.

    Rows without an id are not taken; rows that share an id share their copies, rounded down.
    """
    mixed = mix(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, source_col, most)
    key, times, one = fresh(docs, "_id"), fresh(docs, "_copies"), fresh(docs, "_copy")
    copies = mixed.filter("copies > 0").groupBy(F.col("id").alias(key)).agg((F.sum("copies") / F.count("*")).cast("long").alias(times))
    taken = docs.join(copies.filter(F.col(times) > 0), F.col(id_col).cast("long") == F.col(key))
    return taken.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def op5_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
