import hashlib

import numpy as np
import pytest
from pyspark.sql import Row

from keepsake.llm import sketch as s


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def words(rng, n, size=3000):
    return " ".join(f"w{i}" for i in rng.integers(0, size, n))


def test_estimates_follow_the_truth():
    rng = np.random.default_rng(2)
    for n, share in ((40, 0.5), (900, 0.5), (5000, 0.9), (5000, 0.1)):
        a = words(rng, n)
        cut = int(len(a.split()) * share)
        b = " ".join(a.split()[:cut] + words(rng, n - cut).split())
        x, y, A, B = s.sketch(a), s.sketch(b), shingles(a), shingles(b)
        assert abs(s.resemblance(x, y) - len(A & B) / len(A | B)) < 0.15
        assert abs(s.containment(x, y) - len(A & B) / len(A)) < 0.25
        assert abs(s.distinct(x) / len(A) - 1) < 0.3
        assert (s.merge(x, y) == s.merge(y, x)).all() and (s.merge(x, x) == x).all()


def test_merge_equals_the_sketch_of_all_shingles():
    rng = np.random.default_rng(3)
    parts = [words(rng, 300) for _ in range(4)]
    whole = np.unique(np.concatenate([s.sketch(p, k=10_000) for p in parts]))[:s.K]
    merged = s.sketch(parts[0])
    for p in parts[1:]:
        merged = s.merge(merged, s.sketch(p))
    assert (merged == whole).all()


def test_short_empty_and_repeated_texts():
    assert len(s.sketch(None)) == len(s.sketch(" \n")) == 0 and len(s.sketch("one")) == len(s.sketch("a b c d e")) == 1
    assert s.resemblance(s.sketch(""), s.sketch(None)) == 1.0 and s.resemblance(s.sketch(""), s.sketch("x")) == 0.0
    assert (s.sketch("Ab c " * 5) == s.sketch("aB  C\n" * 5)).all()
    assert len(s.sketch("a b c d e " * 5000)) == 5


def check(rows, docs, order=None):
    docs = sorted(docs, key=order or (lambda d: (d[0] is not None, d[0] or 0, d[1] or "")))
    want = []
    for i, (key, text) in enumerate(docs):
        text, nxt = text or "", docs[(i + 1) % len(docs)][1] or ""
        n = len(text) // 2
        edited = text[:len(text) - n] + nxt[:n]
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), s.text_form(s.sketch(text)), s.text_form(s.sketch(edited)),
                     s.resemblance(s.sketch(text), s.sketch(edited)), s.resemblance(s.sketch(text), s.sketch(nxt))))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = s.op4_sketch(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("rows", [[(5, "only one here now yes")], [(1, None), (1, "é𝄞x y"), (None, "q w e r t y"), (2, ""), (3, "A b c d e f"), (3, "A b c d e f")], []])
def test_nulls_ties_single_and_empty(spark, rows):
    docs = spark.createDataFrame([Row(doc_id=a, text=b, fingerprint="clash") for a, b in rows], "doc_id long, text string, fingerprint string")
    check(s.op4_sketch(docs).collect(), rows)


def test_merged_by_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sk = s.sketches(docs).join(docs.select("doc_id", "source"), s.F.col("id") == s.F.col("doc_id"))
    got = {r.source: list(r.sketch) for r in s.merged(sk, ["source"]).collect()}
    for source, texts in {}.items() or [("src1", [r.text for r in docs.filter("source = 'src1'").collect()])]:
        want = np.unique(np.concatenate([s.sketch(t) for t in texts]))[:s.K]
        assert got[source] == (want ^ np.uint64(1 << 63)).view(np.int64).tolist()


def by_order(spark, docs):
    """Sort key of the operator for rows that share an id: first seven bytes, then Spark's hash of the text."""
    texts = sorted({t or "" for _, t in docs})
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    return lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()[:7].ljust(7, b"\0"), hashes[d[1] or ""])


@pytest.mark.parametrize(("parts", "hot"), [(1, 7), (8, 7), (16, None), (211, 7)])
def test_most_rows_share_an_id(spark, parts, hot):
    n = 40_000
    docs = [(hot if i % 1000 else i - 20_000, f"{'same start ' if i % 3 else i % 11} word {i % 1500}") for i in range(n)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    rows = s.op4_sketch(frame, parts).select("doc_id", "n_chars", "edited_sha256").collect()
    docs.sort(key=by_order(spark, docs))
    want = []
    for i, (key, text) in enumerate(docs):
        half = len(text) // 2
        edited = text[:len(text) - half] + docs[(i + 1) % n][1][:half]
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_a_shared_id_fills_several_ranges(spark):
    docs = spark.range(20_000).selectExpr("7L AS doc_id", "concat('same start ', id) AS text")
    sizes = [r["count"] for r in s._ranged(s._ordered(docs), 8).groupBy("bucket").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 6000


def test_very_long_texts(spark):
    texts = ["1" * 1_000_000, "a " * 500_000, " " * 1_000_000, ",;." * 300_000]
    docs = list(enumerate(texts))
    check(s.op4_sketch(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
