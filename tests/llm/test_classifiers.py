import zlib

import numpy as np

from keepsake.llm import features, quality, toxicity
from keepsake.llm.features import ngram_counts, stem_set


def truth(spark, sf, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    p, n = sum(labels), len(labels) - sum(labels)
    return (sum(o for o, y in zip(order, labels, strict=True) if y) - p * (p - 1) / 2) / (p * n)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op8_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    want = truth(spark, sf, "quality")
    held = [(r.score, r.predicted, want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want]
    assert np.mean([p == y for _, p, y in held]) > 0.93 and auc([s for s, _, _ in held], [y for _, _, y in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = truth(spark, sf, "toxic")
    rows = toxicity.op9_toxicity(docs, labels).filter("held_out").collect()
    held = [(r.score, r.predicted, want[r.doc_id]) for r in rows if r.doc_id in want]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([p == y for _, p, y in held]) > 0.94 and auc([s for s, _, _ in held], [y for _, _, y in held]) > 0.95
    assert np.mean([p for _, p, y in held if y]) > 0.85


def test_labels_of_held_out_rows_are_not_learnt(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    for op in (quality.op8_quality, toxicity.op9_toxicity):
        assert sorted(op(docs, labels).collect()) == sorted(op(docs, odd).collect())


def test_edge_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "x " * 50_000)], "doc_id long, text string").selectExpr("*", "1 AS score")
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or 0, round(r.score, 2), r.held_out) for r in quality.op8_quality(docs, none).collect()) == [(0, 0.5, False), (1, 0.5, False), (1, 0.5, False), (3, 0.5, zlib.crc32(b"3") % 5 == 0)]
    assert {r.score < 1e-9 for r in toxicity.op9_toxicity(docs, none).collect()} == {True}
    assert quality.op8_quality(docs.limit(0), none).count() == toxicity.op9_toxicity(docs.limit(0), none).count() == 0
    assert toxicity.clean(docs, none).columns == docs.columns and toxicity.clean(docs, none).count() == 4


def test_features_of_odd_texts():
    assert len(ngram_counts(None, 18)[0]) == len(ngram_counts("  \n", 18)[0]) == len(stem_set("12 !!", 20)) == 0
    assert abs((ngram_counts("aa BB 12 !? aa aa", 18)[1] ** 2).sum() - 1) < 1e-9


def test_non_negative_risk_separates_planted_words():
    rng = np.random.default_rng(4)
    clean = [np.unique(rng.integers(100, 5000, 60)) for _ in range(900)]
    toxic = [np.unique(np.append(rng.integers(100, 5000, 60), rng.integers(0, 8, 3))) for _ in range(200)]
    w = toxicity.fit(toxic[:100], clean[:600] + toxic[100:160], 0.1, 13)
    score = lambda b: w[b].sum() + w[-1]
    assert np.mean([score(b) > -0.85 for b in toxic[160:]]) > 0.9 and np.mean([score(b) > -0.85 for b in clean[600:]]) < 0.05


def test_rows_that_share_an_id_are_gathered_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (2, None), (3, None)], "doc_id long, text string")
    drawn = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (3, 0)], "id long, label int")
    rows = features.gather(docs, drawn, lambda t: features.ngram_counts(t, 10), "doc_id", "text")
    assert [(r[0], r[1]) for r in rows] == [(1, 0), (1, 1), (2, 1), (3, 0)]
    assert (rows[0][2] == features.ngram_counts("text 0", 10)[0]).all() and (rows[2][2] == features.ngram_counts("b", 10)[0]).all() and not len(rows[3][2])
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    clash = docs.selectExpr("*", "'x' AS label", "1 AS id", "2 AS bucket")
    assert quality.op8_quality(clash, labels).count() == toxicity.op9_toxicity(clash, labels).count() == 503
