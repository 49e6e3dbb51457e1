import hashlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.operators import filters, merge, originals, themes, vectors
from keepsake.operators.drains import Drain, transcribable_work
from keepsake.operators.graph import spread
from keepsake.operators.snapshots import Snapshots
from keepsake.sources import guards, social


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_originals_are_put_once_whoever_brings_them(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = []
    for i in range(24):
        data = f"content {i % 5}".encode() * 1000
        (tmp_path / f"in/{i}.txt").write_bytes(data)
        files.append((f"file:{tmp_path}/in/{i}.txt", ".txt", sha(data) if i % 2 else None))
    files += [(f"{tmp_path}/in/0.txt", ".txt", "0" * 64), (f"{tmp_path}/in/none", None, None), (f"{tmp_path}/in/1.txt", "../x", None), (f"{tmp_path}/in/2.txt", None, None)]
    root = f"{tmp_path}/library"
    rows = originals.put(spark.createDataFrame(files, "path string, ext string, expected string").repartition(6), root).collect()
    good = [r for r in rows if r.code is None]
    assert len(good) == 25 and sum(r.copied for r in good) == 6 and {r.stored_path for r in good if r.ext} == {originals.stored_path(sha(f"content {k}".encode() * 1000), ".txt") for k in range(5)}
    assert sorted(r.code for r in rows if r.code) == ["E_INTEGRITY", "E_NOT_FOUND", "E_PATH_ESCAPE"]
    assert not list((tmp_path / "library").rglob("*.tmp"))
    blobs = spark.createDataFrame([(r.content_hash, r.ext) for r in good], "content_hash string, ext string").distinct()
    spoilt = tmp_path / "library" / good[0].stored_path
    spoilt.write_bytes(b"spoilt")
    assert [r.content_hash for r in originals.verify(blobs, root).collect() if not r.ok] == [good[0].content_hash]
    assert originals.put_one(root, f"{tmp_path}/in/{good[0].path.rsplit('/', 1)[-1]}", ".txt")[2] and all(r.ok for r in originals.verify(blobs, root).collect())
    assert all(r.removed for r in originals.remove(blobs, root).collect()) and not any(r.ok for r in originals.verify(blobs, root).collect())


def test_many_writers_of_one_content_leave_one_blob(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 5_000_000)
    made = []
    threads = [threading.Thread(target=lambda: made.append(originals.put_one(f"{tmp_path}/lib", f"{tmp_path}/a", "bin"))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(m[2] for m in made) == 1 and len({m[1] for m in made}) == 1 and len([f for f in (tmp_path / "lib").rglob("*") if f.is_file()]) == 1


def test_snapshots_stay_while_items_come_and_go(spark, tmp_path):
    store, ran = Snapshots(spark, f"{tmp_path}/s", kept=2), []
    items = spark.range(50).select("id", (F.col("id") % 7).alias("score"))

    def search(rows=items):
        ran.append(1)
        return rows.filter("id % 2 = 0"), [F.desc("score"), F.col("id")]

    first = store.page(items, 0, 5, search)
    order = [r.id for r in items.filter("id % 2 = 0").orderBy(F.desc("score"), "id").collect()]
    assert first.fresh and first.total == 25 and [r.id for r in first.rows.collect()] == order[:5]
    later = items.union(spark.createDataFrame([(100, 99)], "id long, score long")).filter(F.col("id") != order[6])
    second = store.page(later, 5, 5, search, first.token)
    assert not second.fresh and second.token == first.token and [r.id for r in second.rows.collect()] == [i for i in order[5:10] if i != order[6]] and len(ran) == 1
    others = [store.page(items, 0, 1, search).token for _ in range(2)]
    assert store.tokens() == others and not (tmp_path / "s" / first.token).exists()
    again = store.page(items, 5, 5, search, first.token)
    assert again.fresh and again.token != first.token and [r.id for r in again.rows.collect()] == order[5:10]


def test_drains(spark, tmp_path):
    state = {"items": spark.range(25).select("id", F.lit("pending").alias("status")).collect()}
    table = lambda: spark.createDataFrame(state["items"], "id long, status string").filter("status = 'pending'")
    pages = []

    def work(rows):
        return rows.select("id", F.when(F.col("id") % 5 == 0, "skipped").when(F.col("id") == 7, "failed").otherwise("done").alias("status"))

    def settle(done):
        told = {r.id: r.status for r in done.collect()}
        pages.append(len(told))
        state["items"] = [(i, told.get(i, s)) for i, s in state["items"]]

    drain = Drain(spark, f"{tmp_path}/d")
    assert drain.run(table, work, settle, lambda: "no model").reason == "no model" and not pages
    done = drain.run(table, work, settle, page=10)
    assert (done.outcome, done.counts, pages) == ("completed", {"skipped": 5, "failed": 1, "done": 19}, [10, 10, 5])
    assert drain.run(table, work, settle).outcome == "idle" and not drain.cancel()
    state["items"] = [(i, "pending") for i in range(25)]
    inner = []

    def settle_and_more(done):
        settle(done)
        inner.append(Drain(spark, f"{tmp_path}/d").run(table, work, settle).outcome)
        assert drain.cancel()

    assert drain.run(table, work, settle_and_more, page=10).outcome == "cancelled" and inner == ["busy"] and sum(s == "pending" for _, s in state["items"]) == 15
    # Items that stay pending do not make it go round; a run that died loses its lease.
    assert drain.run(table, work, lambda done: None, page=10).counts == {"skipped": 3, "done": 12}
    now = [0.0]
    dead = Drain(spark, f"{tmp_path}/e", lease=5, clock=lambda: now[0])
    assert dead._mark("gone") and dead.run(table, work, settle).outcome == "busy"
    now[0] = 6.0
    assert dead.run(table, work, settle).outcome == "completed"
    items = spark.createDataFrame([(1, "audio", "pending"), (2, "video", "pending"), (3, "photo", "pending"), (4, "audio", "done")], "id long, media_type string, transcript_status string")
    originals_ = spark.createDataFrame([(1, "p"), (2, None), (3, "p"), (4, "p")], "item_id long, stored_path string")
    assert [r.id for r in transcribable_work(items, originals_).collect()] == [1]


def test_vectors_that_do_not_fit_are_errors_of_their_own(spark):
    def embedder(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError
        if any("few" in t for t in texts):
            return np.ones((0, 4))
        return [np.array([2.0, 0, 0, 0]) if "long" in t else np.ones(3) if "short" in t else np.array([np.nan, 0, 0, 0]) if "nan" in t else np.array([0, 1.0, 0, 0]) for t in texts]

    rows = [(i, t, None, "pending") for i, t in enumerate(["fine", "too long", "too short", "nan", None, "boom", "few", "fine"])]
    made = vectors.embed(spark.createDataFrame(rows, "id long, description string, search_meta string, embed_status string").coalesce(1), embedder, 4, batch=5)
    got = {r.id: r.embed_status for r in made.collect()}
    assert got == {0: "done", 1: "error", 2: "error", 3: "error", 4: "skipped", 5: "error", 6: "error", 7: "error"}


def test_guards(spark):
    entries = spark.createDataFrame([("e", f"{'d/' * (i % 40)}f{i:03d}") for i in range(120)] + [("f", "a")], "export string, path string")
    kept, skipped = guards.bounded_entries(entries, entries_limit=50)
    shallow = sorted(r.path for r in entries.collect() if r.export == "e" and r.path.count("/") <= 32)
    assert sorted(r.path for r in kept.filter("export = 'e'").collect()) == shallow[:50] and kept.filter("export = 'f'").count() == 1
    codes = [r.code for r in skipped.collect()]
    assert codes.count("E_DIR_TOO_DEEP") == 121 - len(shallow) - 1 and codes.count("E_ENTRY_LIMIT") == 1
    assert guards.media_index(entries, 7).filter("export = 'e'").count() == 7
    deep = [("[" * 100 + "]" * 100, 100), ('{"a": "[[[\\"[[", "b": [{}]}', 3), ("1", 0), (r'{"x": "\\"}', 1)]
    assert [r[0] for r in spark.createDataFrame(deep, "t string, n int").select(guards.nesting(F.col("t")).alias("d"), "n").collect()] == [n for _, n in deep]
    message = lambda n: '{"sender_name": "A", "content": "hi", "x": ' + "[" * n + "]" * n + "}"
    thread = '{"title": "t", "messages": [' + message(3) + ", " + message(120) + "]}"
    good, bad = social.threads(spark.createDataFrame([("m/messages/inbox/t/message_1.json", thread)], "file string, text string"))
    assert good.count() == 1 and [r.code for r in bad.collect()] == ["E_PARSE"]


def test_projection_lookup_summary_and_sql_function(spark):
    items = spark.createDataFrame([("i", "photo", True), ("j", "video", None)], "id string, media_type string, is_favourite boolean")
    view = filters.item_view(items)
    assert view.columns == list(filters.ITEM_COLUMNS) and [r.is_favourite for r in view.orderBy("id").collect()] == [True, False]
    cats = spark.createDataFrame([("b", "theme:1"), ("a", "theme:1"), ("c", None)], "id string, source_key string")
    assert filters.category_by_source_key(cats, "theme:1").first().id == "a" and filters.category_by_id(cats, "c").count() == 1 and filters.category_by_source_key(cats, "x").count() == 0
    occ = spark.createDataFrame([("s", "i", "in_place"), ("s", "i", "content_addressed"), ("s", "j", "content_addressed"), ("t", "k", "in_place")], "source_id string, item_id string, storage_mode string")
    lost = spark.createDataFrame([("t",), ("u",)], "source_id string")
    assert {tuple(r) for r in filters.ingestion_summary(occ, lost).collect()} == {("s", 3, 2, 2, 1, 0), ("t", 1, 1, 0, 1, 1), ("u", 0, 0, 0, 0, 1)}
    X.register(spark)
    rows = [("a  b a", "b c\td"), (None, "x"), ("", None), ("x", " y x ")]
    frame = spark.createDataFrame(rows, "a string, b string")
    frame.createOrReplaceTempView("pairs_of_tokens")
    got = [r[0] for r in spark.sql("SELECT merge_tokens(a, b) FROM pairs_of_tokens").collect()]
    assert got == [r[0] for r in frame.select(X.merge_tokens(F.col("a"), F.col("b"))).collect()] == ["a b c d", "x", "", "x y"]


def test_token_union_of_a_hot_hash(spark):
    rows = [("h", f"i{i}", "m", i, f"t{i % 3} common  t{(i + 1) % 3}") for i in range(500)] + [(None, "x", "m", 900, "a b a"), ("g", "y", "m", 901, None), ("k", "z", "m", 902, " ")]
    got = {r.content_hash or r.id: (r.id, r.search_meta) for r in merge.upsert_items(spark.createDataFrame(rows, "content_hash string, id string, media_type string, seq long, search_meta string")).collect()}
    assert got == {"h": ("i0", "t0 common t1 t2"), "x": ("x", "a b"), "g": ("y", None), "k": ("z", None)}


def test_a_table_of_few_files_is_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    tasks = spark.sparkContext.defaultParallelism
    parts = spread(one).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == tasks and spread(one).count() == 100
    spark.range(100).repartition(tasks).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert spread(many) is many and spread(spark.range(5).limit(0)).count() == 0


def test_theme_keys_are_those_of_sorted_ids(spark):
    rows = [(i, i % 7 if i % 5 else None) for i in range(200)] + [(None, 1)]
    got = {r.cluster: r.source_key for r in themes.source_keys(spark.createDataFrame(rows, "id long, cluster int").repartition(5)).collect()}
    ids = {}
    for i, c in rows:
        if i is not None:
            ids.setdefault(c, []).append(str(i))
    assert got == {c: "theme:" + sha("\n".join(sorted(v)).encode()) for c, v in ids.items()}
