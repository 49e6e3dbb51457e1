from itertools import combinations_with_replacement

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from keepsake.llm.components import components
from keepsake.llm.simhash import SCHEMES, fingerprint, keep_first, links, masks, near_duplicates


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(prints):
        for j, y in prints[:n]:
            if (x ^ y).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_of_short_long_and_missing_texts():
    for text in ["", " \t\n", "One", "a b c", "A B c D", "x y z w v x y z w", "é É ok go now then", "w " * 70_000]:
        assert fingerprint(text) & (2**64 - 1) == brute_print(text)
    assert fingerprint(None) == 0


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.id: (r.fp, r.component) for r in near_duplicates(docs).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_components(prints)
    assert got == {i: (signed(x), want[i]) for i, x in prints}


@pytest.mark.parametrize(("bucket_pairs", "scheme"), [(512, None), (3, None), (512, (5, 2)), (512, (6, 3)), (3, (6, 3))])
def test_links_of_planted_fingerprints(spark, bucket_pairs, scheme):
    rng = np.random.default_rng(5)
    prints = []
    for base in rng.integers(0, 2**63, 6):
        x = int(base)
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = list(dict.fromkeys(prints))
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    roots = {r.node: r.root for r in components(links(frame, bucket_pairs, scheme)).collect()}
    ids = {signed(x): n for n, x in enumerate(prints)}
    want = brute_components([(n, x) for n, x in enumerate(prints)])
    groups = {}
    for value, n in ids.items():
        groups.setdefault(roots.get(value, value), set()).add(n)
    brute = {}
    for n, r in want.items():
        brute.setdefault(r, set()).add(n)
    assert sorted(map(sorted, brute.values())) == sorted(sorted(g & set(ids.values())) for g in groups.values())


def test_long_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (101, 102)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [Row(doc_id=1, text="a b c d e", fp="x"), Row(doc_id=1, text="a b c d e", fp="x"), Row(doc_id=3, text=None, fp=None),
            Row(doc_id=2, text="", fp="y"), Row(doc_id=None, text="a b c d e", fp="z"), Row(doc_id=9, text="other words stand here now", fp="q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.id or -1, r.component) for r in near_duplicates(docs).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 2), (3, 2), (9, 9)]
    assert sorted((r.doc_id or -1, r.fp) for r in keep_first(docs).collect()) == [(-1, "z"), (1, "x"), (2, "y"), (9, "q")]
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("segments", "together"), [(s, k) for _, s, k in SCHEMES])
def test_four_bits_always_leave_a_key_with_at_most_one(segments, together):
    keys = masks(segments, together)
    lengths = {k.bit_count() for k in keys}
    assert max(lengths) - min(lengths) <= together
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    for some in combinations_with_replacement(range(segments), 4):  # which segments the bits are in is all that counts
        taken = {}
        differ = sum(1 << edges[k] + taken.setdefault(k, iter(range(4))).__next__() for k in some)
        assert any((differ & key).bit_count() <= 1 for key in keys)


def test_each_pair_is_taken_once_at_a_signature_that_both_have(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 1, base ^ (1 << 63), base ^ 0b1111, base ^ (1 | 1 << 20 | 1 << 40 | 1 << 60), base ^ 0b11111 << 8]
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    want = sorted(sorted((signed(x), signed(y))) for i, x in enumerate(prints) for y in prints[:i] if (x ^ y).bit_count() <= 4)
    for _, *scheme in SCHEMES:
        assert sorted(sorted((r.a, r.b)) for r in links(frame, scheme=tuple(scheme)).collect()) == want


def test_the_signatures_are_made_in_as_many_tasks_as_asked_for(spark):
    frame = spark.range(1000).select(F.xxhash64("id").alias("fp")).groupBy("fp").count().select("fp")
    plan = links(frame)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_signatures_are_joined_by_shuffle(spark):
    """Exploded rows look few to Spark, which would send all of them to the driver."""
    prints = spark.range(400).selectExpr("xxhash64(id DIV 2) ^ shiftleft(1L, cast(id % 2 * 3 as int)) AS fp")
    for most in (512, 1):
        found = links(prints, bucket_pairs=most)
        assert len({frozenset(r) for r in found.collect()}) >= 200
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert "SortMergeJoin" in plan and all("LeftAnti" in j or "LeftSemi" in j for j in joins), joins
