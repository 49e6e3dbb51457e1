"""Themes: greedy clustering of vectors, TF/DF labels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.text import WRITTEN, fold, fold_text
from keepsake.operators.graph import cut
from keepsake.operators.greedy import clusters_in_blocks, greedy_clusters

THRESHOLD, MIN_SIZE = 0.82, 3
LABEL_TERMS = 3
LABEL_CONFIDENCE = 0.5
#: Function words by kind: articles and pronouns; prepositions and conjunctions; auxiliary verbs and adverbs.
FUNCTION_WORDS = {
    "English": ("a an the this that these those i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours ourselves "
                "they them their theirs themselves who whom whose which what "
                "about above after against among and as at because before behind below between but by down during for from if in into nor of off on or out over since so "
                "than then through to under until up upon while with without "
                "am is are was were be been being do does did doing done have has had having can could may might must shall should will would "
                "again all also any both each few here how just more most no not now once only other own same some such there too very when where why"),
    "Spanish": ("el la los las lo un una unos unas este esta esto estos estas ese esa eso esos esas yo tú él ella ello nosotros vosotros ellos ellas usted ustedes me te se nos os le les mi mis "
                "tu tus su sus nuestro nuestra vuestro que quien quienes cual cuales "
                "a al ante bajo con contra de del desde durante en entre hacia hasta para por según sin sobre tras y e o u ni pero sino porque pues si como cuando donde mientras aunque "
                "es son soy eres era eran fue fueron ser sido está están estaba estar ha han he hay había haber tiene tengo tener "
                "algo algunos cada más menos mucho muchos muy no nada otro otra otros poco sí también tanto todo toda todos todas ya aquí así"),
    "Portuguese": ("o a os as um uma uns umas este esta isto esse essa isso aquele aquela aquilo eu tu ele ela nós vós eles elas você vocês me te se lhe lhes nos meu minha teu tua seu sua seus suas "
                   "nosso nossa que quem qual quais "
                   "ao aos à às de do da dos das em no na nas num numa com contra desde entre até para por pelo pela pelos pelas sem sob sobre e ou nem mas porque pois se como quando onde enquanto "
                   "é são sou era eram foi foram ser sido está estão estava estar há havia haver tem têm tenho ter "
                   "algo cada mais menos mesmo muito muitos não nada outro outra pouco sim também tudo todo toda todos todas já aqui assim"),
}
STOPWORDS = tuple(sorted({fold_text(w) for words in FUNCTION_WORDS.values() for w in words.split()}))


def clusters(vectors: DataFrame, shard: Column | None = None, threshold: float = THRESHOLD, min_size: int = MIN_SIZE) -> DataFrame:
    """(id, shard, cluster, similarity) of vectors (id, vector); items in too small clusters have no row.

    The method goes through its items one by one, so a shard is one task, and its size is for the caller to
    bound: give a shard key (a model, a year, a source) that keeps shards small. Without one there is a single shard.
    """
    keyed = vectors.select("id", "vector", (F.lit("") if shard is None else shard.cast("string")).alias("shard"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        found = greedy_clusters(frame["id"].tolist(), np.stack(frame["vector"].tolist()), threshold, min_size)
        out = frame[["id", "shard"]].assign(cluster=[c for c, _ in found], similarity=[s for _, s in found])
        return out[out["cluster"] >= 0]

    kind = vectors.schema["id"].dataType.simpleString()
    return keyed.groupBy("shard").applyInPandas(run, f"id {kind}, shard string, cluster int, similarity double")


def source_keys(members: DataFrame) -> DataFrame:
    """(cluster, source_key): theme:<sha-256 of the sorted member ids, one a line>.

    Ids come in order as a stream, of which a task holds the hash alone, so a cluster may have any number of members.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, made = None, None
        for batch in batches:
            out = []
            for cluster, key in zip(batch["cluster"], batch["id"], strict=True):
                if made is None or cluster != at:
                    if made is not None:
                        out.append((at, f"theme:{made.hexdigest()}"))
                    at, made = cluster, hashlib.sha256()
                else:
                    made.update(b"\n")
                made.update(key.encode())
            yield pd.DataFrame(out, columns=["cluster", "source_key"])
        if made is not None:
            yield pd.DataFrame([(at, f"theme:{made.hexdigest()}")], columns=["cluster", "source_key"])

    kind = members.schema["cluster"].dataType.simpleString()
    ids = members.filter("id is not null").select(F.col("cluster").cast("string").alias("cluster"), F.col("id").cast("string").alias("id"))
    keys = ids.repartition("cluster").sortWithinPartitions("cluster", "id").mapInPandas(run, "cluster string, source_key string")
    return keys.select(F.col("cluster").cast(kind).alias("cluster"), "source_key")


def terms(texts: DataFrame, text_col: str = "text", stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(id, term, surface, n): how often each item of texts (id, text) writes a word so; term is folded, stopwords (given folded) have no row.

    Words are counted as written before they are folded, so that folding goes once over an item's spellings. Texts are dealt
    by their items, so that they are shuffled once and none of what is counted of an item is shuffled by it again.
    """
    words = texts.select("id", F.col(text_col).alias("text")).repartition("id").select("id", F.explode(_words(F.col("text"))).alias("surface"))
    # A term that is generated is folded once, whatever filters ask of it.
    counted = words.groupBy("id", "surface").agg(F.count("*").alias("n")).select("*", F.explode(F.array(fold(F.col("surface")))).alias("term"))
    return counted.filter((F.length("term") > 1) & ~F.col("term").isin(*stopwords)).select("id", "term", "surface", "n")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WRITTEN), F.lit(0))


def _folded(sums: DataFrame) -> DataFrame:
    """sums with the term of each surface; as terms(), but folding once a row of sums."""
    return sums.withColumn("term", F.explode(F.array(fold(F.col("surface"))))).filter((F.length("term") > 1) & ~F.col("term").isin(*STOPWORDS))


def spelt_in(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, term, surface, n) of texts (id, text), counted by clusters at once: nothing is counted, sorted or kept by item."""
    words = texts.select("id", "text").join(members.select("id", "cluster"), "id").select("cluster", F.explode(_words(F.col("text"))).alias("surface"))
    return _folded(words.groupBy("cluster", "surface").agg(F.count("*").alias("n"))).select("cluster", "term", "surface", "n")


def counted_in(texts: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster, term, surface, n) of the members, and (term, df), the number of items that have a term, from one pass over texts (id, text).

    A text's words go straight into the sums of its clusters, and each of its terms once into the number of items; terms are told
    by item only where several rows share an id, which are one item. A row without an id is no item.
    """
    held = members.filter("id is not null").groupBy("id").agg(F.collect_list(F.struct("cluster")).alias("clusters"))
    rows = F.count("*").over(Window.partitionBy("id"))
    told = texts.filter("id is not null").select("id", "text").join(held, "id", "left").withColumn("item", F.when(rows > 1, F.col("id")))
    words = _words(F.col("text"))
    # A sigma's small form depends on what is around it: there, words are folded one by one.
    terms_ = F.when(F.col("text").contains("Σ"), F.array_distinct(F.transform(F.array_distinct(words), fold))).otherwise(F.array_distinct(_words(fold(F.col("text")))))
    none = F.lit(None).cast(members.schema["cluster"].dataType)
    spelt = F.transform("clusters", lambda c: F.struct(F.lit(True).alias("held"), c["cluster"].alias("cluster"), words.alias("tokens")))
    had = F.array(F.struct(F.lit(False).alias("held"), none.alias("cluster"), terms_.alias("tokens")))
    both = told.select("item", F.inline(F.concat(F.coalesce(spelt, F.slice(had, 1, 0)), had)))
    tokens = both.select("held", "cluster", F.when(~F.col("held"), F.col("item")).alias("item"), F.explode("tokens").alias("surface"))
    sums = cut(tokens.groupBy("held", "cluster", "item", "surface").agg(F.count("*").alias("n")))
    df = sums.filter("not held").groupBy(F.col("surface").alias("term")).agg(F.sum(F.when(F.col("item").isNull(), F.col("n")).otherwise(1)).alias("df"))
    return _folded(sums.filter("held").select("cluster", "surface", "n")).select("cluster", "term", "surface", "n"), df


def _spellings(words: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, term, surface, n) from terms()."""
    return words.join(members.select("id", "cluster"), "id").groupBy("cluster", "term", "surface").agg(F.sum("n").alias("n"))


def _counted(words: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster, term, surface, n) of the members, and (term, df), the number of items that have a term; from one pass over terms().

    Of an item's spellings of a term the first tells the item. Rows stay where terms() dealt their items to, so that only sums
    over many items are shuffled and kept.
    """
    first = F.row_number().over(Window.partitionBy("id", "term").orderBy("surface")) == 1
    # An item of several clusters counts once.
    lead = F.row_number().over(Window.partitionBy("id").orderBy("cluster")) == 1
    told = words.withColumn("first", first).join(members.select("id", "cluster").withColumn("lead", lead), "id", "left")
    items = F.sum((F.col("first") & F.coalesce("lead", F.lit(True))).cast("long"))
    sums = cut(told.groupBy("cluster", F.col("lead").isNotNull().alias("held"), "term", "surface").agg(F.sum("n").alias("n"), items.alias("items")))
    return sums.filter("held").select("cluster", "term", "surface", "n"), sums.groupBy("term").agg(F.sum("items").alias("df"))


def ranked_terms(words: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, term, tf, df, score): how often a cluster has a term, over the number of items that have it anywhere."""
    return _ranked(*_counted(words, members))


def ranked_terms_in(texts: DataFrame, members: DataFrame) -> DataFrame:
    """ranked_terms() of texts (id, text) that are not counted by item."""
    return _ranked(*counted_in(texts, members))


def _ranked(spelt: DataFrame, frequencies: DataFrame) -> DataFrame:
    tf = spelt.groupBy("cluster", "term").agg(F.sum("n").alias("tf"))
    return tf.join(frequencies, "term").withColumn("score", F.col("tf") / F.col("df"))


def _display(spellings: DataFrame) -> DataFrame:
    """(cluster, term, display): the most frequent spelling, the smallest of equals."""
    return spellings.groupBy("cluster", "term").agg(F.min_by("surface", F.struct(-F.col("n"), F.col("surface"))).alias("display"))


def surface_forms(words: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, term, display) from terms(): how a cluster mostly writes each term."""
    return _display(_spellings(words, members))


def surface_forms_in(texts: DataFrame, members: DataFrame) -> DataFrame:
    """surface_forms() of texts (id, text) that are not counted by item."""
    return _display(spelt_in(texts, members))


def labels(words: DataFrame, members: DataFrame, n: int = LABEL_TERMS) -> DataFrame:
    """(cluster, label, confidence): the best terms by score, then term, with a capital at the front; '' and 0 without terms."""
    return _labelled(*_counted(words, members), members, n)


def labels_in(texts: DataFrame, members: DataFrame, n: int = LABEL_TERMS) -> DataFrame:
    """labels() of texts (id, text) that are not counted by item."""
    return _labelled(*counted_in(texts, members), members, n)


def _labelled(spelt: DataFrame, frequencies: DataFrame, members: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "term")
    top = cut(_ranked(spelt, frequencies).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("cluster", "term", "place"))
    shown = top.join(_display(spelt.join(top, ["cluster", "term"], "left_semi")), ["cluster", "term"])
    made = shown.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "display"))), lambda x: x["display"]), " ").alias("l"))
    all_ = members.select("cluster").distinct().join(made, "cluster", "left").withColumn("l", F.coalesce("l", F.lit("")))
    return all_.select("cluster", F.concat(F.upper(F.substring("l", 1, 1)), F.expr("substring(l, 2)")).alias("label"),
                       F.when(F.col("l") == "", 0.0).otherwise(LABEL_CONFIDENCE).alias("confidence"))


def plan(members: DataFrame, labelled: DataFrame) -> DataFrame:
    """(item_id, source_key, name, confidence, explanation) for each clustered item."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    named = labelled.join(sizes, "cluster").join(source_keys(members), "cluster").select("cluster", "source_key", F.coalesce(
        F.nullif("label", F.lit("")), F.concat(F.col("size").cast("string"), F.lit(" similar items"))).alias("name"))
    return members.join(named, "cluster").select(F.col("id").alias("item_id"), "source_key", "name", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")).alias("confidence"),
                                                 F.concat(F.lit("Similar to other items in “"), "name", F.lit("”")).alias("explanation"))


def item_statuses(items: DataFrame, assigned: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, status) of categorised items (id, has_signal): error, done (assigned, or only noise) or skipped without a signal."""
    return (items.join(failed.select("id", F.lit(True).alias("_e")), "id", "left").join(assigned.select(F.col("item_id").alias("id"), F.lit(True).alias("_a")).distinct(), "id", "left")
            .select("id", F.when(F.col("_e"), "error").when(F.col("_a") | F.col("has_signal"), "done").otherwise("skipped").alias("status")))


def gate(opted_in: bool, places: bool, themes: bool) -> str:
    """ready, or why a run is refused."""
    return "refused:not-opted-in" if not opted_in else "ready" if places or themes else "refused:no-signal"


