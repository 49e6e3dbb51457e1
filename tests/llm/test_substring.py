import hashlib

import numpy as np
import pytest

from keepsake.llm import substring as s
from keepsake.llm.automaton import SuffixAutomaton


def brute(docs, width=13):
    first = {}
    for key, text in docs:
        w = (text or "").encode().split()
        for j in range(len(w) - width + 1):
            if key is not None:
                k = tuple(w[j:j + width])
                first[k] = min(first.get(k, key), key)
    out = []
    for key, text in docs:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if key is not None and first[tuple(w[j:j + width])] < key:
                gone[j:j + width] = [True] * width
        out.append((key, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def test_automaton_against_all_runs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        passages = sorted((int(o), [b"%d" % x for x in rng.integers(0, 3, rng.integers(1, 25))]) for o in rng.integers(0, 9, 5))
        auto = SuffixAutomaton(passages)
        text = [b"%d" % x for x in rng.integers(0, 3, 60)]
        for width in (1, 3, 5):
            least = {}
            for owner, p in passages:
                for j in range(len(p) - width + 1):
                    least.setdefault(tuple(p[j:j + width]), owner)
            for below in (4, None):
                want = [(o := least.get(tuple(text[j:j + width]))) is not None and (below is None or o < below) for j in range(len(text) - width + 1)]
                assert auto.matched(text, width, below).tolist() == want


@pytest.mark.parametrize(("chunk", "shard"), [(7, 30), (1000, 40_000)])
def test_random_documents_with_common_passages(spark, chunk, shard):
    rng = np.random.default_rng(8)
    passages = [[f"p{i}x{j}" for j in range(rng.integers(13, 40))] for i in range(4)]
    docs = []
    for i in range(90):
        w = [f"w{x}" for x in rng.integers(0, 4 if i % 3 else 4000, rng.integers(0, 60))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(0, 4)]
            a = rng.integers(0, 5)
            w[len(w) // 2:len(w) // 2] = p[a:a + rng.integers(10, 40)]
        docs.append((i // 2 if i % 10 == 0 else i, " ".join(w)))
    docs += [(5, docs[7][1]), (None, docs[9][1]), (200, None), (201, ""), (3, docs[3][1]), (300, docs[20][1]), (301, "a\0b " * 20), (302, "a\0b " * 15)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS chunk")
    got = s.deduplicated(frame, chunk_rows=chunk, shard_words=shard).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_one_id_many_ids_and_none_over_small_chunks(spark):
    rng = np.random.default_rng(9)
    shared = [" ".join(f"s{i}x{j}" for j in range(20)) for i in range(3)]
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"a{i} {shared[rng.integers(0, 3)]} b{i} {shared[rng.integers(0, 3)]}") for i in range(120)]
    docs += docs[:30] + [(None, None), (7, None), (7, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (1000, 1 << 25):
        assert sorted(map(tuple, s.deduplicated(frame, chunk_bytes=size).collect()), key=str) == brute(docs)
    unnamed = frame.filter("doc_id is null")
    assert s.deduplicated(unnamed).agg({"n_removed": "sum"}).first()[0] == 0 and s.deduplicated(unnamed).count() == unnamed.count()


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in s.op3_substring(docs).collect()), key=str)
    assert got == [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in want]


def test_broadcast_reference_and_empty_tables(spark):
    ref = spark.createDataFrame([(1, " ".join(f"r{i}" for i in range(30))), (2, None)], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"r{i}" for i in range(5, 20)) + " c"), (2, " ".join(f"r{i}" for i in range(12))), (None, None)], "doc_id long, text string")
    got = sorted((r.id or 0, r.n_removed, r.kept[:7]) for r in s.without_reference(docs, ref).collect())
    assert got == [(0, 0, ""), (1, 15, "a b c"), (2, 0, "r0 r1 r")]
    assert s.deduplicated(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="may be broadcast"):
        old, s.REFERENCE_WORDS = s.REFERENCE_WORDS, 3
        try:
            s.without_reference(docs, ref)
        finally:
            s.REFERENCE_WORDS = old
