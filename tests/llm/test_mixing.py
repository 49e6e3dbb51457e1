import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from keepsake.llm import mixing as m


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    whole, capped = sum(sizes.values()), set()
    while True:
        left, w = whole - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else left * weight[s] / w for s in order}
        capped |= over


def check(rows, docs, near=0.02):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, s in docs:
        total[s] = total.get(s, 0) + size(t)
    goal = brute_targets(total)
    by = {}
    assert sorted((r.id or -1, r.size) for r in rows) == sorted((i or -1, size(t)) for i, t, _ in docs)
    for r in rows:
        assert 0 <= r.copies <= 3 and r.source_size == total[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        by[r.source] = by.get(r.source, 0) + r.copies * r.size
    for s, taken in by.items():
        assert abs(taken - goal[s]) <= near * goal[s] + 3, (s, taken, goal[s])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    first = m.mix(docs).collect()
    check(first, rows)
    again = m.mix(docs.repartition(7, "lang")).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_caps_nulls_and_repeats(spark):
    rows = [(i, "w " * (i % 50 + 1), "big") for i in range(400)] + [(1000 + i, "a b c", "tiny") for i in range(5)] + [(2000, "x y z", None), (2001, None, "void"), (2001, None, "void"), (None, "q " * 30, "big")]
    docs = spark.createDataFrame([Row(doc_id=a, text=b, source=c, size="clash") for a, b, c in rows], "doc_id long, text string, source string, size string")
    got = m.mix(docs, part_rows=60).collect()
    check(got, rows)
    assert all(r.copies == 3 for r in got if r.source == "tiny")


def test_apply_keeps_columns_and_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("_id", F.lit("x"))
    want = {r.id: r.copies for r in m.mix(docs).collect() if r.copies}
    out = m.apply_mix(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


@pytest.mark.parametrize("text", [None, "a"])
def test_empty_and_single(spark, text):
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert m.mix(docs.limit(0)).count() == 0
    assert m.mix(docs).first().copies == (1 if text else 0)
