"""A training corpus from raw documents: each stage works on what the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import decontam, mixing, neardup, tokens, toxicity
from keepsake.llm.common import shared_folder, table
from keepsake.llm.features import remainder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score as clean. Labels are learnt from the rows that op9 may learn from."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 4) != 2))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles, the document with the smallest id.

    Candidates come from deletion variants of SimHash segments, as in op1, over a fingerprint wide enough for that similarity.
    """
    return neardup.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight wants it."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents, as read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.op2_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-id output", token_stage),
]

#: Classifier, near duplicates and tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next.

    Null, empty and white-space texts are one near-duplicate group and of size 0, so the mix may take none of
    them; rows without an id pass the filters, and the mix leaves them out, as it names what it takes; very
    long texts are read whole by every stage; rows that share an id count as one document from the
    near-duplicate stage on, the first of them. Empty documents give an empty result.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
