import zlib

import numpy as np

import corpus_pipeline as p
from keepsake.llm import mixing, toxicity
from keepsake.llm.tokens import Encoder, default_tokenizer
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_names():
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None


def test_run_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = toxicity.clean(docs, labels.filter("crc32(cast(doc_id as string)) % 4 <> 2")).collect()
    root = brute([(r.doc_id, r.text) for r in sorted(kept)])
    kept = [r for r in kept if root[r.doc_id] == r.doc_id]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: [w for w in ("".join(c for c in x if c.isalnum()).lower() for x in t.split()) if w]
    grams = {tuple(w[j:j + 8]) for r in bench.collect() for w in [norm(r.text)] for j in range(len(w) - 7)}
    kept = [r for r in kept if not any(tuple(w[j:j + 8]) in grams for w in [norm(r.text)] for j in range(len(w) - 7))]
    copies = {r.id: r.copies for r in mixing.mix(spark.createDataFrame(kept, docs.schema)).collect()}
    encoder, want, start = Encoder(default_tokenizer()), [], 0
    for r in sorted(kept):
        ids = encoder.ids([r.text])[0] + np.array([2], "<u4").tobytes()
        for _ in range(copies[r.doc_id]):
            want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
            start += len(ids) // 4
    assert sorted(map(tuple, p.run(spark, SF).collect()), key=lambda r: r[1]) == want


def test_empty_documents_go_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_rows_without_an_id_nulls_and_long_texts_go_through(spark):
    """Rows without an id pass the filters and are not mixed, as nothing could name them; other rows come out as tokens."""
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))
    rows = [(1, "some plain words stand here", "en", "a", 27), (2, None, None, None, None), (None, "no name for these words here", "en", "a", 28), (3, long, "en", "b", len(long)), (4, long, "en", "b", len(long)), (5, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} <= {1, 2, 3, 5} and 3 in {r.doc_id for r in out}
