import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.operators import categorize, greedy, places, speech, themes
from keepsake.operators.graph import components


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * places.EARTH_METRES * math.asin(min(1, math.sqrt(h)))


def naive_dbscan(points, eps=1500.0, least=3):
    ids = sorted(points)
    near = {i: [j for j in ids if metres(points[i], points[j]) <= eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= least}
    label, n = {}, 0
    for i in ids:
        if i in core and i not in label:
            todo = [i]
            while todo:
                k = todo.pop()
                if k in label:
                    continue
                label[k] = n
                if k in core:
                    todo += [j for j in near[k] if j not in label]
            n += 1
    return {i: label.get(i) for i in ids}


def cluster(spark, points, **options):
    rows = [(i, float(a), float(b)) for i, (a, b) in points.items()]
    return {r.id: r.cluster for r in places.dbscan(spark.createDataFrame(rows, "id long, lat double, lon double"), **options).collect()}


STEP = 1 / 111_195.0


@pytest.mark.parametrize("centre", [(0.0, 0.0), (48.8, 2.3), (10.0, 179.999), (89.995, 30.0), (-65.0, -180.0)])
def test_dbscan_equals_the_naive_method(spark, centre):
    rng = np.random.default_rng(int(abs(centre[0]) * 10) + 1)
    points = {}
    for i in range(70):
        lat = centre[0] + rng.normal() * 3500 * STEP
        lat = 180 - lat if lat > 90 else lat
        lon = (centre[1] + rng.normal() * 3500 * STEP / max(0.01, math.cos(math.radians(lat))) + 180) % 360 - 180
        points[i] = points[i - 7] if i % 11 == 10 else (lat, lon)
    assert cluster(spark, points) == naive_dbscan(points)


@pytest.mark.parametrize(("centre", "seed"), [((0.0, 0.0), 1), ((55.0, 179.99), 2), ((-89.99, 0.0), 3)])
def test_dbscan_of_dense_cells_equals_the_naive_method(spark, centre, seed):
    """Full cells whose nearest points are just in reach, or just out of it."""
    rng = np.random.default_rng(seed)
    points = {}
    for blob in range(6):
        east, north = blob % 3 * rng.uniform(1900, 2300), blob // 3 * rng.uniform(1900, 2300)
        for _ in range(40):
            lat = centre[0] + (north + rng.uniform(-350, 350)) * STEP * (-1 if centre[0] > 80 else 1)
            lon = (centre[1] + (east + rng.uniform(-350, 350)) * STEP / max(1e-4, math.cos(math.radians(lat))) + 180) % 360 - 180
            points[len(points)] = (lat, lon)
    for _ in range(30):
        points[len(points)] = (centre[0] + rng.uniform(0, 4500) * STEP, (centre[1] + rng.uniform(0, 6500) * STEP / max(1e-4, math.cos(math.radians(centre[0]))) + 180) % 360 - 180)
    for least in (3, 8):
        assert cluster(spark, points, min_points=least) == naive_dbscan(points, least=least)


def test_a_million_points_in_one_city(spark):
    u = lambda seed: F.rand(seed) * 6000 * STEP
    points = spark.range(0, 1_000_000, 1, 8).select("id", (F.lit(48.0) + u(1)).alias("lat"), (F.lit(2.0) + u(2)).alias("lon")).unionByName(spark.createDataFrame([(2_000_000, 10.0, 10.0)], "id long, lat double, lon double"))
    began = time.time()
    got = {r["cluster"]: r["count"] for r in places.dbscan(points).groupBy("cluster").count().collect()}
    assert got == {0: 1_000_000, None: 1} and time.time() - began < 120


def test_dbscan_borders_and_options(spark):
    two = {i: (0.0 if i < 3 else 0.1, (i % 3) * 1e-4) for i in range(6)}
    assert cluster(spark, two) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert cluster(spark, {0: (0.0, 0.0), 1: (1400 * STEP, 0.0)}, min_points=2) == {0: 0, 1: 0} and cluster(spark, {0: (0.0, 0.0), 1: (1600 * STEP, 0.0)}, min_points=2) == {0: None, 1: None}
    line = {0: (0.0, 0.0), 1: (1400 * STEP, 0.0), 2: (2400 * STEP, 0.0), 3: (2500 * STEP, 0.0)}
    assert cluster(spark, line) == {0: 0, 1: 0, 2: 0, 3: 0}
    for bad in ({"metres": 0}, {"metres": math.inf}, {"min_points": 0}, {"min_points": 1.5}):
        with pytest.raises(ValueError, match="distance"):
            cluster(spark, two, **bad)


def test_nearest_by_cells(spark):
    rng = np.random.default_rng(5)
    at = lambda n: [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), strict=True))]
    town, probe = at(120), at(40)
    t, p = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (town, probe))
    want = {i: min(town, key=lambda x: (metres((a, b), x[1:]), x[0]))[0] for i, a, b in probe}
    assert {r.id: r.place_id for r in places.nearest(p, t).collect()} == want
    one = spark.createDataFrame([(7, 0.0, 0.0)], "id long, lat double, lon double")
    far = spark.createDataFrame([(1, 0.0, 179.9), (2, -90.0, 5.0)], "id long, lat double, lon double")
    assert {r.id: r.place_id for r in places.nearest(far, one).collect()} == {1: 7, 2: 7}
    assert places.nearest(p, one.limit(0)).count() == 0 and places.nearest(p.limit(0), t).count() == 0


def wavering(df, *columns):
    """df with another last bit in its columns each time that it is computed, as sums have that are taken in another order."""
    near = F.udf(lambda x: float(x * (1 + random.randrange(1, 1 << 20) * 1e-16)), "double").asNondeterministic()
    return df.withColumns({c: near(c) for c in columns})


def test_nearest_of_points_that_waver(spark):
    town = spark.range(30).selectExpr("id", "id * 4D - 60 AS lat", "id * 12D - 180 AS lon")
    points = wavering(spark.range(20).selectExpr("id", "id * 4D - 59 AS lat", "id * 12D - 179 AS lon"), "lat", "lon")
    assert {r.id: r.place_id for r in places.nearest(points, town).collect()} == {i: i for i in range(20)}


def test_places_are_named_where_means_waver(spark, monkeypatch):
    made = places.centroids
    monkeypatch.setattr(places, "centroids", lambda points, clusters: wavering(made(points, clusters), "lat", "lon"))
    points = spark.range(12).selectExpr("id", "id % 3 * 10D + id * 0.0001D AS lat", "id % 3 * 20 + 1D AS lon")
    town = spark.range(3).selectExpr("id", "'T' || id AS name", "id * 10D AS lat", "id * 20D AS lon", "'' AS admin1", "'N' AS country")
    assert {(r.item_id, r.source_key, r.name) for r in places.plan(points, town).collect()} == {(i, f"place:{i % 3}", f"T{i % 3}, N") for i in range(12)}


def test_items_keep_their_places_where_means_waver(spark, monkeypatch):
    made = places.centroids
    monkeypatch.setattr(places, "centroids", lambda points, clusters: wavering(made(points, clusters), "lat", "lon"))
    items = spark.range(12).selectExpr("id", "id % 3 * 10D + id * 0.0001D AS lat", "id % 3 * 20 + 1D AS lon", "IF(id % 3 = 0, array(1f, 0f), null) AS vector")
    town = spark.range(3).selectExpr("id", "'T' || id AS name", "id * 10D AS lat", "id * 20D AS lon", "'' AS admin1", "'N' AS country")
    run = categorize.categorise(items, items.selectExpr("id", "'sea' AS text"), town)
    assert {(r.item_id, r.kind, r.name) for r in run.assignments.collect()} == {(i, "place", f"T{i % 3}, N") for i in range(12)} | {(i, "theme", "Sea") for i in range(0, 12, 3)}


def naive_themes(vectors, threshold, least):
    clusters = []
    for i, v in enumerate(vectors.astype(np.float32).astype(float)):
        best, score = None, -2.0
        for c in clusters:
            m = c["centre"]
            n = math.sqrt(m @ m) * math.sqrt(v @ v)
            s = m @ v / n if n else 0.0
            if s > score:
                best, score = c, s
        if best is None or score < threshold:
            best = {"sum": np.zeros(len(v)), "ids": []}
            clusters.append(best)
        best["sum"] += v
        best["ids"].append(i)
        best["centre"] = (best["sum"] / len(best["ids"])).astype(np.float32).astype(float)
    return [c["ids"] for c in clusters if len(c["ids"]) >= least]


def test_greedy_themes_equal_the_naive_method(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(12, 16)), 6, axis=0) + rng.normal(size=(72, 16)) * 0.4
    found = themes.greedy_clusters(list(range(72)), x, 0.7, 3)
    groups = {}
    for i, (c, _) in enumerate(found):
        if c >= 0:
            groups.setdefault(c, []).append(i)
    assert [groups[c] for c in sorted(groups)] == naive_themes(x, 0.7, 3)
    frame = spark.createDataFrame([(int(i), [float(z) for z in x[i]]) for i in rng.permutation(72)], "id long, vector array<float>").repartition(5)
    assert {(r.id, r.cluster) for r in themes.clusters(frame, None, 0.7).collect()} == {(i, c) for c, ids in groups.items() for i in ids}
    for ids, vectors in (([1, 1], np.ones((2, 2))), ([1], np.array([[np.nan]]))):
        with pytest.raises(ValueError, match="repeat|finite"):
            themes.greedy_clusters(ids, vectors, 0.8, 3)


@pytest.mark.parametrize(("block", "found", "in_hand"), [(7, 2, 0), (30, 1, 0), (30, 16, 1 << 20), (1000, 16, 1 << 20)])
def test_themes_across_blocks_equal_the_naive_method(spark, block, found, in_hand):
    """However small a block, and whether centroids are found beforehand or all in hand."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate((centres[rng.integers(0, 6, 60)] + rng.normal(size=(60, 8)) * 0.5, rng.normal(size=(10, 8)), centres[:3], np.zeros((1, 8))))[rng.permutation(74)].astype(np.float32)
    frame = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (7, None)], "id long, vector array<float>").repartition(5)
    rows = themes.clusters_in_blocks(frame, 0.8, 3, block, found, in_hand).collect()
    want = naive_themes(x, 0.8, 3)
    assert {(r.id // 3, r.cluster) for r in rows} == {(i, n) for n, ids in enumerate(want) for i in ids} and len(rows) == sum(map(len, want))
    one = themes.greedy_clusters(list(range(len(x))), x, 0.8, 3)
    assert all(one[r.id // 3] == (r.cluster, r.similarity) for r in rows)


def test_replay_over_many_blocks_equals_one_block():
    """20,000 vectors in blocks of 500, centroids found beforehand."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(900, 24))
    x = (centres[rng.integers(0, 900, 20_000)] + rng.normal(size=(20_000, 24)) * 0.35).astype(np.float32)
    whole = greedy.InHand(24)
    want = greedy.replay(x, whole, 0, 0.75)
    state, founded, got, rounds = {}, 0, [], 0
    while len(got) < len(x):
        block = x[len(got):len(got) + 500]
        lists, more = [[] for _ in block], np.zeros(len(block), bool)
        if state:
            numbers = np.array(sorted(state))
            i, j, sims = greedy._reaching(block.astype(float), np.stack([greedy.centre_of(*state[n]) for n in numbers]), 0.75)
            for k in np.lexsort((numbers[j], -sims, i)):
                lists[i[k]].append((float(sims[k]), int(numbers[j[k]])))
            more = np.array([len(found) > 16 for found in lists])
            lists = [found[:16] for found in lists]
        hand = greedy.InHand(24)
        of = greedy.replay(block, hand, founded, 0.75, lists, more, state)
        state |= {n: (hand.sums[k].copy(), hand.counts[k]) for n, k in hand.at.items()}
        founded, rounds = len(state), rounds + 1
        got += of
    assert got == want and rounds < 80


def test_prefix_bounds_lose_no_pair():
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(60, 200)), rng.normal(size=(40, 200))
    b[:20] = a[:20] + rng.normal(size=(20, 200)) * 0.4
    i, j, sims = greedy._reaching(a, b, 0.8)
    every = a @ b.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(z.tolist() for z in np.nonzero(every >= 0.8)), strict=True)) and np.allclose(sims, every[i, j])


def test_themes_of_bad_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "id long, vector array<float>")
    assert themes.clusters_in_blocks(frame.limit(0), 0.9, 3).count() == 0
    for bad in (frame.union(frame.limit(1)), spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], frame.schema), spark.createDataFrame([(1, [float("nan")])], frame.schema)):
        with pytest.raises(ValueError, match="repeat|finite"):
            themes.clusters_in_blocks(bad, 0.9, 3)


def test_theme_labels(spark):
    texts = spark.createDataFrame([(1, "Playa playa sunset the"), (2, "playa Sunset"), (3, "cumpleaños de Ana"), (4, "the and of")], "id long, text string")
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2)], "id long, cluster int")
    got = {r.cluster: (r.label, r.confidence) for r in themes.labels(themes.terms(texts), members).collect()}
    assert got == {0: ("Playa Sunset", 0.5), 1: ("Ana cumpleaños", 0.5), 2: ("", 0.0)}
    assert themes.gate(False, True, True).startswith("refused") and themes.gate(True, False, True) == "ready"


def test_components_of_a_chain(spark):
    nodes, edges = spark.range(60), spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 55)], "a long, b long")
    got = {r.id: r.root for r in components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 40 else 50 if i == 55 else i for i in range(60)}


def test_word_errors(spark):
    assert speech.align("a b c".split(), "a x c d".split()) == (1, 0, 1) and speech.align(["a"], []) == (0, 1, 0) and speech.align([], []) == (0, 0, 0)
    rows = speech.word_errors(spark.createDataFrame([("Hola, ¿qué tal?", "hola que tal"), ("", "x")], "reference string, heard string")).collect()
    assert [(r.words, r.substitutions, r.deletions, r.insertions) for r in rows] == [(3, 1, 0, 0), (0, 0, 0, 1)] and rows[1].wer is None


def test_labels_keep_no_words_of_items(spark, monkeypatch):
    """Only sums over items are kept; an item of two spellings or two clusters counts once among the items that have a term."""
    kept = []
    monkeypatch.setattr(themes, "cut", lambda df, cut=themes.cut: kept.append(df.columns) or cut(df))
    texts = spark.createDataFrame([(1, "Mar mar MAR luna"), (2, "mar"), (2, "sol Luna"), (3, None), (4, "luna río")], "id long, text string")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "id long, cluster string")
    words = themes.terms(texts)
    got = {(r.cluster, r.term): (r.tf, r.df) for r in themes.ranked_terms(words, members).collect()}
    assert got == {("a", "mar"): (4, 2), ("b", "mar"): (3, 2), ("a", "luna"): (2, 3), ("b", "luna"): (1, 3), ("a", "sol"): (1, 1)}
    assert {r.cluster: r.label for r in themes.labels(words, members).collect()} == {"a": "Mar sol Luna", "b": "MAR luna", None: ""}
    assert kept and not any("id" in columns for columns in kept)


def test_clusters_stay_in_hand_between_blocks(spark, monkeypatch):
    """Small clusters are written once, at the end, whatever the number of blocks; those that grow too large are put down between blocks."""
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(9, 8))
    x = (centres[rng.integers(0, 9, 90)] + rng.normal(size=(90, 8)) * 0.4).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(4)
    one = themes.greedy_clusters(list(range(90)), x, 0.8, 3)
    turns, write = [], greedy.Clusters._write
    monkeypatch.setattr(greedy.Clusters, "_write", lambda self, state: turns.append(self.founded) or write(self, state))
    for in_hand, few in ((1 << 20, True), (8 * 8 * 4, False)):
        turns.clear()
        rows = themes.clusters_in_blocks(frame, 0.8, 3, 4, 2, in_hand).collect()
        assert {(r.id, r.cluster, r.similarity) for r in rows} == {(i, *c) for i, c in enumerate(one) if c[0] >= 0}
        assert (len(turns) == 1) == few


def test_words_are_counted_from_texts_as_by_item(spark):
    """Repeated ids, several clusters, several spellings and a sigma whose small form depends on what follows give what terms() gives."""
    texts = spark.createDataFrame([(1, "Mar mar MAR luna ΟΔΟΣ.Α ΟΔΟΣ"), (2, "mar"), (2, "sol Luna MAR"), (3, None), (4, "luna río RÍO the"), (5, "οδοσ İx x̀y")], "id long, text string")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (5, "b")], "id long, cluster string")
    words = themes.terms(texts)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    ranked = ["cluster", "term", "tf", "df", "score"]
    assert rows(themes.ranked_terms_in(texts, members).select(ranked)) == rows(themes.ranked_terms(words, members).select(ranked))
    assert rows(themes.surface_forms_in(texts, members)) == rows(themes.surface_forms(words, members))
    assert rows(themes.labels_in(texts, members)) == rows(themes.labels(words, members))
