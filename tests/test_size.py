"""Plans of steps that failed at size: what they must not do, on small tables."""

from pyspark.sql import functions as F

from keepsake.operators import places, themes
from keepsake.sources import archives


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pictures(spark, n=60):
    media = spark.range(n).selectExpr("'d' || id % 2 AS dir", "'img' || id || '.jpg' AS name", "timestamp'2020-01-01' AS modified")
    jsons = spark.range(n).filter("id % 4 <> 0").selectExpr("'d' || id % 2 AS dir", "'img' || id || '.jpg.json' AS json", "'{\"description\": \"t' || id || '\"}' AS text")
    return media, jsons


def test_sidecars_are_matched_without_a_broadcast(spark):
    found = archives.sidecars(*pictures(spark))
    assert "Broadcast" not in plan(found)
    assert {(r.name, r.sidecar) for r in found.collect()} == {(f"img{i}.jpg", f"img{i}.jpg.json" if i % 4 else None) for i in range(60)}


def test_photo_records_are_joined_without_a_broadcast(spark):
    made = archives.photos(*pictures(spark))
    assert "Broadcast" not in plan(made)
    assert {(r.sourceRef, r.body) for r in made.collect()} == {(f"d{i % 2}/img{i}.jpg", f"t{i}" if i % 4 else None) for i in range(60)}


def globe(spark, n):
    return spark.range(n).selectExpr("id", "id * 0.3819660113 % 1 * 120 - 60 AS lat", "id * 0.7320508076 % 1 * 360 - 180 AS lon")


def test_near_pairs_are_dealt_over_all_tasks(spark):
    p = globe(spark, 80)
    pairs = places.near_pairs(p, p, 1_500_000.0)
    assert "Broadcast" not in plan(pairs) and plan(pairs).count("REPARTITION_BY_NUM") == 2
    d = places.haversine(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon"))
    want = p.alias("p").crossJoin(p.alias("q")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), d.alias("d")).filter("d <= 1500000")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))


def test_points_at_one_place_are_one_search(spark, monkeypatch):
    sizes, made = [], places.near_pairs
    monkeypatch.setattr(places, "near_pairs", lambda a, b, metres: sizes.append((a.count(), b.count())) or made(a, b, metres))
    points = spark.range(900).selectExpr("id", "cast(id % 3 as double) AS lat", "cast(id % 3 * 60 as double) AS lon").unionByName(spark.sql("SELECT 1000L AS id, cast(null as double) AS lat, 1D AS lon"))
    got = {r.id: r.place_id for r in places.nearest(points, globe(spark, 40)).collect()}
    assert all(min(pair) <= 3 for pair in sizes) and len(got) == 900 and len(set(got.values())) == 3


def test_words_are_not_shuffled_by_what_is_counted_of_an_item(spark):
    texts = spark.createDataFrame([(1, "Cat cat Dog"), (2, "cat"), (1, "cat")], "id long, text string")
    words = themes.terms(texts)
    assert plan(words).count("Exchange") == 1 and "REPARTITION_BY_COL" in plan(words)
    assert sorted((r.id, r.term, r.surface, r.n) for r in words.collect()) == [(1, "cat", "Cat", 1), (1, "cat", "cat", 2), (1, "dog", "Dog", 1), (2, "cat", "cat", 1)]
