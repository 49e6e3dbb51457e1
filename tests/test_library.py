"""Writes of a library: categories by key, automatic assignments, vectors by model, accept and merge."""

from keepsake.operators import curation, merge


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_known_key_changes_the_name_alone_and_a_null_key_is_new(spark):
    shape = "id string, kind string, name string, source_key string"
    now = spark.createDataFrame([("a", "place", "Old", "k1"), ("n", "theme", "Bare", None)], shape)
    new = spark.createDataFrame([("x", "theme", "First", "k1", 1), ("y", "theme", "Last", "k1", 2), ("z", "theme", "Bare", None, 3), ("w", "place", "New", "k2", 4)], shape + ", seq int")
    found = curation.upsert_categories(now, new).select("id", "kind", "name", "source_key")
    assert rows(found) == [("a", "place", "Last", "k1"), ("n", "theme", "Bare", None), ("w", "place", "New", "k2"), ("z", "theme", "Bare", None)]


def test_automatic_assignments_leave_users_alone(spark):
    now = spark.createDataFrame([(1, 7, "user", "removed", None), (1, 7, "auto", "assigned", 0.1), (2, 7, "auto", "assigned", 0.2)], "item_id int, category_id int, source string, state string, confidence double")
    new = spark.createDataFrame([(1, 7, 1, 0.5), (1, 7, 2, 0.6), (3, 7, 3, 0.9)], "item_id int, category_id int, seq int, confidence double")
    assert rows(curation.assign_auto(now, new)) == [(1, 7, "auto", "assigned", 0.6), (1, 7, "user", "removed", None), (2, 7, "auto", "assigned", 0.2), (3, 7, "auto", "assigned", 0.9)]


def test_vectors_are_replaced_by_item_and_model(spark):
    now = spark.createDataFrame([(1, "m", [1.0]), (1, "o", [2.0])], "item_id int, model_id string, vector array<float>")
    new = spark.createDataFrame([(1, "m", [3.0], 1), (1, "m", [float("inf")], 2), (1, "o", [], 3)], "item_id int, model_id string, vector array<float>, seq int")
    assert rows(merge.replace_vectors(now, new)) == [(1, "m", [3.0]), (1, "o", [2.0])]


def test_accept_and_merge_twice_adds_members_once(spark):
    a = spark.createDataFrame([(1, 7, "auto", "assigned"), (2, 7, "auto", "assigned")], "item_id int, category_id int, source string, state string")
    g = spark.createDataFrame([(7, "place", "Here")], "id int, kind string, name string")
    c = spark.createDataFrame([("c1", "Mine", "user", None)], "id string, name string, origin string, category_id int")
    i = spark.createDataFrame([("c1", 1)], "collection_id string, item_id int")
    for _ in range(2):
        c, i = curation.accept_and_merge(a, g, c, i, 7, "c1")
        assert rows(i) == [("c1", 1), ("c1", 2)]
        assert rows(c.select("id", "origin")) == [("c1", "user"), ("dismissed:7", "dismissed")]
