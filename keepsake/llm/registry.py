"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepsake.llm import decontam, mixing, negatives, pii, quality, repair, repetition, secrets, simhash, sketch, substring, tokens, toxicity
from keepsake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, name) for name in ("documents", *names)))


QUERIES: dict[str, Query] = {
    "op1_simhash": _on(simhash.op1_simhash),
    "op2_tokens": _on(tokens.op2_tokens),
    "op3_substring": _on(substring.op3_substring),
    "op4_sketch": _on(sketch.op4_sketch),
    "op5_mixing": _on(mixing.op5_mixing),
    "op6_secrets": _on(secrets.op6_secrets),
    "op7_pii": _on(pii.op7_pii),
    "op8_quality": _on(quality.op8_quality, "labels"),
    "op9_toxicity": _on(toxicity.op9_toxicity, "labels"),
    "op10_decontam": _on(decontam.op10_decontam, "benchmark"),
    "op11_hard_negatives": lambda spark, sf_dir: negatives.op11_hard_negatives(table(spark, sf_dir, "embeddings")),
    "op12_repair": lambda spark, sf_dir: repair.op12_repair(table(spark, sf_dir, "conversations")),
    "op13_quality_rules": _on(repetition.op13_quality_rules),
}
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": negatives.ORACLE,
    "op13_quality_rules": repetition.ORACLE,
    "op3_substring": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      windows AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
      hit AS (SELECT doc_id, p FROM windows JOIN (SELECT k, min(doc_id) AS least FROM windows GROUP BY k) USING (k) WHERE least < doc_id),
      gone AS (SELECT DISTINCT doc_id, p + o AS i FROM hit, (SELECT unnest(range(0, 13)) AS o)),
      words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
      kept AS (SELECT w.doc_id, count(*) AS n, count(g.i) AS r, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS t FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
      SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)""",
}
