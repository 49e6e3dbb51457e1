import hashlib
import re

from keepsake.llm import decontam as d
from keepsake.llm import secrets


def no_python(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


def test_secrets_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = set()
    for r in docs.collect():
        for m in re.finditer(r'AKIA[0-9A-Z]{16}|(?i:password)=([0-9a-fA-F]{12,})|(?i:token) = "([0-9a-fA-F]{40})', r.text):
            v = m[1] or m[2] or m[0]
            want.add((r.doc_id, r.text.index(v, m.start()), len(v), hashlib.sha256(v.encode()).hexdigest()))
    found = secrets.op6_secrets(docs)
    no_python(found)
    got = {(r.doc_id, r.start, r.length, r.value_sha256) for r in found.collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_candidates_have_their_places(spark):
    texts = ["é😀 token = \"abcdef1234567890\" and 123456789012 x", "none", "", None, "abcdef1234567890abcdef1234567890", "a1b2c3d4e5f6g7 a1b2c3d4e5f6g7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'v' AS value")
    rows = secrets.candidates(docs).collect()
    assert len(rows) == 5
    for r in rows:
        assert texts[r.id][r.start:r.start + len(r.value)] == r.value and texts[r.id][:r.start].endswith(r.before)
    assert secrets.op6_secrets(docs.limit(0)).count() == 0
    assert {r.doc_id for r in secrets.op6_secrets(docs.union(docs)).collect()} == {0}


ITEM = "Which engine pulls 40 km of wagons if Anna leaves the old station near 9 and Bruno waits there for 40 minutes"
BENCH = [(1, ITEM), (2, "too short"), (3, None), (None, "the words of this item have no number to name them by")]


def flagged(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS item", "1 AS h")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = d.op10_decontam(docs, bench)
    no_python(found)
    return docs, bench, {r.doc_id: r.item_ids for r in found.collect()}


def test_exact_new_and_inconsistent_parameters(spark):
    new = ITEM.replace("40", "75").replace("Anna", "Clara").replace("9", "11").replace("Bruno", "Dora")
    odd = ITEM.replace("40 km", "75 km").replace("Anna", "Clara")
    swap = ITEM.replace("40", "9").replace("Bruno", "Anna")
    texts = ["some words first " + ITEM + " and more", new, ITEM.upper() + "!!", odd, swap, "nothing of the kind is here at all, only plain words without any item", "", None, "The Big Red Fox Ran Over A Hill Near Old York Town"]
    docs, bench, found = flagged(spark, texts)
    assert found.get(0) == [1] and found.get(1) == [1]
    assert 3 not in found and 4 not in found and not {5, 6, 7, 8} & set(found)
    kept = d.decontaminated(docs.union(docs.limit(1)), bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(range(9)) - set(found))
    assert d.decontaminated(docs.limit(0), bench).count() == 0 and d.matches(docs, bench.limit(0)).count() == 0


def test_planted_passages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: [w for w in (re.sub(r"[^\w]+", "", x).lower() for x in t.split()) if w]
    grams = {tuple(w[j:j + 8]) for r in bench.collect() for w in [norm(r.text)] for j in range(len(w) - 7)}
    want = {r.doc_id for r in docs.collect() for w in [norm(r.text)] if any(tuple(w[j:j + 8]) in grams for j in range(len(w) - 7))}
    got = {r.doc_id for r in d.op10_decontam(docs, bench).collect()}
    assert len(want) > 10 and got == want


def test_very_long_texts(spark):
    texts = ["1," * 1_000_000, "1" * 1_000_000, "a " * 500_000, "A" * 1_000_000, "Ab " * 300_000, "!" * 1_000_000, " " * 1_000_000, ITEM + " 7" * 500_000]
    _, _, found = flagged(spark, texts)
    assert found == {7: [1]}
    assert secrets.op6_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0


def test_short_items_are_looked_for_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "so name the green river of Lund today"), (2, "name the green river"), (3, "name the green river of 12 and more"), (4, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "Name the green river of Lund"), (6, "the green"), (7, ITEM), (8, "so so so so so so")], "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in d.op10_decontam(docs, bench).collect()} == {1: [5], 4: [7]}


def test_a_window_that_many_items_share(spark):
    shared = "the same eight words begin every one of them"
    bench = spark.createDataFrame([(i, f"{shared} then {i} follows") for i in range(200)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{shared} and no more") for i in range(200)], "doc_id long, text string")
    assert all(len(r.item_ids) == 200 for r in d.op10_decontam(docs, bench).collect())
