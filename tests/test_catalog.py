import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.log import Conflict
from keepsake.operators import curation, filters, merge, search, timeline, vectors
from keepsake.operators.stored import StoredIndex


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


TIMELINE = [("a", "2020-01-03"), ("b", "2020-01-02"), ("c", "2020-01-02"), ("d", "2020-01-01"), ("e", None), ("f", None)]


@pytest.mark.parametrize("limit", [1, 2, 3, 6, 7])
def test_timeline_pages_tile_the_whole(spark, limit):
    items, seen, cursor = frame(spark, "id string, capture_date string", TIMELINE), [], None
    while True:
        rows = timeline.page(items, limit, cursor).collect()
        seen += [r.id for r in rows]
        cursor = timeline.next_cursor(rows, limit)
        if cursor is None:
            break
        cursor = timeline.decode_cursor(timeline.encode_cursor(cursor))
    assert seen == ["a", "c", "b", "d", "f", "e"]


@pytest.mark.parametrize("raw", ["", "x", "e30", timeline.encode_cursor((1, "a")), timeline.encode_cursor((None, None))])
def test_bad_cursors_are_refused(raw):
    with pytest.raises(ValueError, match="not a cursor"):
        timeline.decode_cursor(raw)


def items(spark, rows):
    return frame(spark, "id long, title string, description string, search_meta string, capture_date string, media_type string", rows)


def test_search_is_a_prefix_and(spark):
    docs = items(spark, [(1, None, "Feliz cumpleaños a toda la familia", None, None, "message"), (2, "Familia", "nada", "foo-bar.jpg ana", None, "photo")])
    hits = lambda q: sorted(r.id for r in search.search(docs, q, 10).collect())
    assert hits("cumple") == [1] and hits("FAMÍLIA") == [1, 2] and hits("fam nad") == [2] and hits("fam zzz") == []
    assert hits("foo-ba") == [2] and hits("bar-foo") == [] and hits("!!! ---") == [] and hits("") == []


def test_ties_and_relevance(spark):
    same = items(spark, [(i, None, "same text", None, None if i < 3 else "2020-01-01", "message") for i in range(1, 6)])
    assert [r.id for r in search.search(same, "same", 10).collect()] == [5, 4, 3, 2, 1]
    rows = [(1, None, "rare " + "filler " * 60, None, None, "message"), (2, None, "rare rare rare", None, None, "message")] + [(i, None, "other words", None, None, "message") for i in range(3, 9)]
    assert [r.id for r in search.search(items(spark, rows), "rare", 10).collect()] == [2, 1]


def test_filters_reach_past_the_first_page(spark):
    rows = [(i, None, "word word word", None, "2020-01-01T00:00:00.000Z", "photo") for i in range(30)] + [(99, None, "word and much more besides", None, "2020-02-01T10:00:00.000Z", "audio"), (98, None, "word", None, None, "audio")]
    docs = items(spark, rows)
    narrow = filters.by_date(filters.by_type(docs, ["audio"]), None, "2020-02-01")
    assert [r.id for r in search.search(narrow, "word", 5, corpus=docs).collect()] == [99]
    assert filters.by_type(docs, []).count() == 32 and filters.by_date(docs).count() == 32


def test_snapshot_pages_ignore_later_changes(spark):
    docs = items(spark, [(i, None, "w " * i, None, None, "message") for i in range(1, 8)])
    frozen = search.snapshot(docs.select("id"), [F.col("id").desc()], {"q": "w"}).persist()
    token = frozen.first().token
    assert sorted(r.id for r in search.snapshot_page(frozen, docs, token, 2, 3).collect()) == [3, 4, 5]
    assert search.snapshot_page(frozen, docs, "other", 0, 3).count() == 0


def test_item_upsert_is_first_wins_by_column_and_idempotent(spark):
    delta = frame(spark, "id string, media_type string, title string, capture_date string, search_meta string, content_hash string, seq long",
                  [("a", "photo", None, "d1", "x y", "h", 1), ("b", "video", "t2", "d2", "y z", "h", 2), ("c", "message", None, None, None, None, 3), ("d", "message", None, None, None, None, 4)])
    once = merge.upsert_items(delta)
    row = once.filter("content_hash = 'h'").first()
    assert (row.id, row.media_type, row.title, row.capture_date, row.search_meta) == ("a", "photo", "t2", "d1", "x y z")
    assert once.filter("content_hash is null").count() == 2
    again = once.withColumn("seq", F.lit(0).cast("long")).unionByName(delta.select(*once.columns, "seq")).filter("content_hash is not null")
    assert sorted(merge.upsert_items(again).collect(), key=str) == sorted(once.filter("content_hash is not null").select(*merge.upsert_items(again).columns).collect(), key=str)


def test_undo_keeps_shared_items(spark):
    sources, its = frame(spark, "id string", [("s1",), ("s2",)]), frame(spark, "id string, content_hash string", [("i1", "h1"), ("i2", "h2"), ("i3", "h1")])
    occ = frame(spark, "id string, item_id string, source_id string", [("o1", "i1", "s1"), ("o2", "i1", "s2"), ("o3", "i2", "s1"), ("o4", "i3", "s1")])
    left = merge.remove_source(sources, its, occ, "s1")
    assert {r.id for r in left["items"].collect()} == {"i1"} and {r.content_hash for r in left["blobs"].collect()} == {"h2"} and left["occurrences"].count() == 1
    assert {r.id for r in merge.remove_occurrence(its, occ, "o3")["items"].collect()} == {"i1", "i3"}


@pytest.mark.parametrize(("auto", "user", "state", "member"), [("assigned", None, "assigned", True), ("assigned", "removed", "removed", False), ("assigned", "assigned", "assigned", True), (None, "assigned", "assigned", True), (None, "removed", "removed", False)])
def test_user_wins(spark, auto, user, state, member):
    rows = [(1, 1, w, s) for w, s in (("auto", auto), ("user", user)) if s]
    a = frame(spark, "item_id long, category_id long, source string, state string", rows)
    assert curation.effective(a).first().state == state and bool(curation.members(a).count()) == member


def test_suggestions_accept_merge_dismiss(spark):
    a = frame(spark, "item_id long, category_id long, source string, state string", [(i, c, "auto", "assigned") for c, n in ((1, 5), (2, 4), (3, 4), (4, 2)) for i in range(n)])
    cats = frame(spark, "id long, kind string, name string", [(1, "place", "P"), (2, "theme", "T"), (3, "theme", "U"), (4, "place", "V")])
    cols = frame(spark, "id string, name string, origin string, category_id long", [("u1", "Mine", "user", None)])
    got = curation.candidates(a, cats, cols).orderBy(F.col("member_count").desc(), "category_id").collect()
    assert [(r.category_id, r.member_count) for r in got] == [(1, 5), (2, 4), (3, 4)]
    assert [r.item_id for r in curation.examples(a, curation.candidates(a, cats, cols)).filter("category_id = 1").orderBy("place").collect()] == [0, 1, 2, 3]
    made, rows = curation.accept(a, cats, cols, 2)
    cols = cols.unionByName(made)
    assert rows.count() == 4 and curation.accept(a, cats, cols, 2)[0].count() == 0
    merged, left = curation.merge_collections(cols, rows.unionByName(frame(spark, "collection_id string, item_id long", [("u1", 0), ("u1", 9)])), "suggested:2", "u1")
    assert left.filter("collection_id = 'u1'").count() == 5 and merged.filter("origin = 'dismissed' and category_id = 2").count() == 1
    assert {r.category_id for r in curation.candidates(a, cats, curation.dismiss(merged, cats, 3)).collect()} == {1}
    with pytest.raises(ValueError, match="itself"):
        curation.merge_collections(cols, rows, "u1", "u1")
    with pytest.raises(ValueError, match="no such"):
        curation.rename(cols, "none", "x")


def test_knn_and_merge(spark):
    v = frame(spark, "id string, vector array<float>, model_id string", [("a", [1.0, 0.0], "m"), ("b", [1.0, 0.0], "m"), ("z", [0.0, 0.0], "m"), ("o", [1.0, 0.0, 0.0], "m"), ("n", [1.0, 0.0], "other")])
    assert [(r.id, r.score) for r in vectors.knn(v, [2.0, 0.0], 3, "m").collect()] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]
    assert vectors.knn(v, [1.0, 0.0], 0).count() == 0
    exact = frame(spark, "id string, pos int", [("e1", 1), ("e2", 2)])
    semantic = frame(spark, "id string, score double", [("s1", 0.9), ("e2", 0.95), ("s2", 0.5), ("s1", 0.2), ("bad", -0.1)])
    got = vectors.merge_hits(exact, semantic, 3).orderBy(F.col("pos").asc_nulls_last(), F.col("score").desc()).collect()
    assert [(r.id, r.origin) for r in got] == [("e1", "exact"), ("e2", "both"), ("s1", "semantic")]
    assert vectors.merge_hits(exact, semantic, 1).count() == 2
    assert [list(r[0]) for r in frame(spark, "b binary", [(vectors.encode_vector([1.5, -2.0]),)]).select(vectors.decode_vectors(F.col("b"))).collect()] == [[1.5, -2.0]]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda s: F.lit(s)
    assert one(X.fold(lit("ÀÉñ ß Ø"))) == "aen ß ø"
    assert one(X.merge_tokens(lit("a b  a"), lit(None).cast("string"), lit("c b"))) == "a b c"
    assert one(X.repair_mojibake(lit("JosÃ©"))) == "José" and one(X.repair_mojibake(lit("José"))) == "José" and one(X.repair_mojibake(lit("日"))) == "日"
    assert one(X.unescape_mbox(lit(">>From x"))) == ">From x" and one(X.unescape_mbox(lit("From: x"))) == "From: x"
    assert one(X.duration_label(lit(125.7))) == "2:05" and one(X.highlight(lit("Ab ab"), "AB")) == "[Ab] [ab]"
    assert one(X.safe_segment(lit("../a:b"))) == "_a_b" and one(X.safe_segment(lit(".."))) == "untitled"
    assert one(X.search_tokens(lit("x/y.jpg"), lit(None).cast("string"))) == "y.jpg"


def test_a_stored_index_reads_the_row_groups_of_the_tokens_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("keepsake.operators.stored.ROW_GROUP", 1 << 12)
    rows = [(i, f"word{i % 97} tail{i}", None, None, None) for i in range(3000)]
    items = spark.createDataFrame(rows, "id long, title string, description string, search_meta string, capture_date string")
    index = StoredIndex(spark, f"{tmp_path}/index")
    assert index.postings().count() == 0 and index.terms("w").count() == 0
    index.add(items)
    index.add(items.filter("id < 10").withColumn("title", F.lit("word5 fresh")), items.filter("id = 20"))
    want = {r.id for r in items.filter("id >= 10 and id <> 20 and id % 97 = 5").collect()} | set(range(10))
    for _ in range(2):
        hits = search.phrase_hits(index.postings(), ["word5"]).filter("f > 0")
        found = search.matches(index.postings(), "word5-")
        assert {r.id for r in found.collect()} >= want and {r.id for r in search.phrase_hits(index.postings(), ["word5", "t"]).collect()} == {i for i in want if i >= 10}
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "StringStartsWith(token,word5)" in plan
        index.merge()
    assert len(index.segments()) == 1 and {r.token: r["items"] for r in index.terms("fres").collect()} == {"fresh": 10}
    groups = [pq.ParquetFile(f) for f in (tmp_path / "index").rglob("postings/*.parquet")]
    assert sum(g.num_row_groups for g in groups) > 4
    other = StoredIndex(spark, f"{tmp_path}/index")
    number = other.log.last()
    index.add(items.limit(1))
    with pytest.raises(Conflict):
        other.log.append(number + 1, {"segments": []})


def test_postings_shuffle_no_tokens(spark, monkeypatch):
    """Texts are dealt once; rows of one id are one item, also over several batches, and nulls have no row."""
    monkeypatch.setattr(search, "BATCH", 2)
    rows = [(1, "a b a", None), (1, "b", "a"), (1, "a", "c"), (1, None, "b"), (None, "n", ""), (None, "n", "x"), (2, "", None), (3, "Ünï b", "b")]
    items = spark.createDataFrame(rows, "id long, title string, description string")
    found = search.postings(items, ("title", "description"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    gap = search.COLUMN_GAP
    assert sorted(((r.id or 0, r.token, list(r.places), r.n) for r in found.collect())) == [
        (0, "n", [0, 0], 2), (0, "x", [gap], 1), (1, "a", [0, 0, 2, gap], 4), (1, "b", [0, 1, gap], 3), (1, "c", [gap], 1), (3, "b", [1, gap], 2), (3, "uni", [0], 1)]
    assert search.postings(items.limit(0), ("title", "description")).count() == 0
