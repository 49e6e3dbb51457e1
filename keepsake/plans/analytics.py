"""Vectors, places, themes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.operators import categorize, places, search, themes, vectors
from keepsake.operators.graph import cut
from keepsake.plans import tables as t
from keepsake.plans.catalog import _bm25


def _vectors(s, d):
    return t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model_id"))


def _query(s, d):
    return t.table(s, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def knn_cosine(s, d):
    return vectors.knn(_vectors(s, d), _query(s, d), 20).select("id", F.round("score", 6).alias("score"))


def knn_guarded_dim(s, d):
    """Vectors of another model or another dimension are not compared."""
    v = _vectors(s, d).withColumn("vector", F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector")))
    return vectors.knn(v, _query(s, d), 15, "m1").select("id", F.round("score", 6).alias("score"))


def merge_exact_semantic(s, d):
    items = t.items(s, d)
    hits = items.select("id", "capture_date").join(search.ranked(items, "heat"), "id").orderBy(F.round("rank", 9), F.col("capture_date").desc_nulls_last(), F.col("id").desc()).limit(10)
    exact = hits.select("id", F.row_number().over(Window.orderBy(F.round("rank", 9), F.col("capture_date").desc_nulls_last(), F.col("id").desc())).alias("pos"))
    return vectors.merge_hits(exact, vectors.knn(_vectors(s, d), _query(s, d), 30), 25).select("id", "origin", F.round("score", 6).alias("score"), "pos")


def passage_texts(s, d):
    p = vectors.input_line(vectors.passage_text(F.col("description"), F.col("search_meta")))
    return t.items(s, d).select("id", F.md5(p).alias("passage_md5"))


def embed_drain(s, d):
    """Every pending item through the deterministic embedder."""
    items = t.items(s, d).select("id", F.when(F.col("id") % 13 != 0, F.col("description")).alias("description"), F.when(F.col("id") % 13 != 0, F.col("search_meta")).alias("search_meta"), F.lit("pending").alias("embed_status"))
    made = vectors.embed(items, vectors.hashing_embedder(64), 64)
    return made.select("id", "embed_status", F.size("vector").alias("dim"), F.round(vectors.dot(F.col("vector"), F.col("vector")), 4).alias("length"))


def haversine_pairs(s, d):
    p = t.gazetteer(s, d).select("id", "lat", "lon")
    return places.near_pairs(p, p, 1_500_000.0).filter("a < b").select("a", "b", F.round("d", 3).alias("d"))


def nearest_gazetteer(s, d):
    near = places.nearest(t.points(s, d), t.gazetteer(s, d))
    return near.select("id", "place_id", F.round("d", 3).alias("d"))


def places_dbscan(s, d):
    return places.dbscan(t.points(s, d))


def places_centroids(s, d):
    p = t.points(s, d)
    return places.centroids(p, places.dbscan(p)).select("cluster", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


def places_plan(s, d):
    p = places.plan(t.points(s, d), t.gazetteer(s, d))
    return p.select("item_id", "source_key", "name", "confidence", "explanation")


def _themed(s, d):
    """Documents as texts, their language as the cluster."""
    docs = t.table(s, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), "text"), docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster"))


def theme_terms_tfdf(s, d):
    texts, members = _themed(s, d)
    return themes.ranked_terms_in(texts, members).select("cluster", "term", "tf", "df", F.round("score", 6).alias("score"))


def theme_surface_forms(s, d):
    texts, members = _themed(s, d)
    return themes.surface_forms_in(texts, members)


def theme_labels(s, d):
    texts, members = _themed(s, d)
    return themes.labels_in(texts, members)


def theme_clusters(s, d):
    v = t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return themes.clusters_in_blocks(v, 0.3, themes.MIN_SIZE).select("id", "cluster", F.round("similarity", 6).alias("similarity"))


def theme_source_key(s, d):
    return themes.source_keys(t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")))


def theme_plan(s, d):
    v = t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    members = cut(themes.clusters_in_blocks(v, 0.3, themes.MIN_SIZE))
    texts = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return themes.plan(members, themes.labels_in(texts, members)).select("item_id", "source_key", "name", F.round("confidence", 6).alias("confidence"))


def _to_categorise(s, d):
    """Documents with coordinates (but for every seventh), vectors where there are some."""
    v = t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    p = t.points(s, d)
    return p.select("id", *[F.when(F.col("id") % 7 != 0, F.col(c)).alias(c) for c in ("lat", "lon")]).join(v, "id", "left")


def categorise_items(s, d):
    """A whole run: each item's categories, place and theme, and its status."""
    texts = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    failed = t.table(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    run = categorize.categorise(_to_categorise(s, d), texts, t.gazetteer(s, d), failed, threshold=0.3)
    return run.statuses.join(run.assignments.withColumnRenamed("item_id", "id"), "id", "left").select("id", "status", "kind", "source_key", "name", F.round("confidence", 6).alias("confidence"))


def category_status_settle(s, d):
    items = t.items(s, d).select("id", (F.col("id") % 3 != 0).alias("has_signal"))
    assigned = t.table(s, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("item_id"))
    failed = t.table(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return themes.item_statuses(items, assigned, failed)


QUERIES = {f.__name__: f for f in (knn_cosine, knn_guarded_dim, merge_exact_semantic, passage_texts, embed_drain, haversine_pairs, nearest_gazetteer, places_dbscan, places_centroids,
                                   places_plan, theme_terms_tfdf, theme_surface_forms, theme_labels, theme_clusters, theme_source_key, theme_plan, categorise_items, category_status_settle)}

_COSINE = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_KNN = f"SELECT e.vec_id AS id, {_COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_STOP = ", ".join(f"'{w}'" for w in themes.STOPWORDS)
_WORDS = rf"words AS (SELECT id, cluster, surface, strip_accents(lower(surface)) AS term FROM (SELECT doc_id AS id, lang AS cluster, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS surface FROM documents) WHERE length(strip_accents(lower(surface))) > 1 AND strip_accents(lower(surface)) NOT IN ({_STOP}))"
_RANKED = "ranked AS (SELECT cluster, term, count(*) AS tf, any_value(df) AS df, count(*) / any_value(df) AS score FROM words JOIN (SELECT term, count(DISTINCT id) AS df FROM words GROUP BY term) USING (term) GROUP BY cluster, term)"
_FORMS = "forms AS (SELECT cluster, term, arg_min(surface, {'n': -n, 's': surface}) AS display FROM (SELECT cluster, term, surface, count(*) AS n FROM words GROUP BY ALL) GROUP BY cluster, term)"
_DBSCAN = f"""{t.POINTS}, f AS (SELECT lat, lon, min(id) AS id, count(*) AS w FROM points GROUP BY lat, lon),
  pairs AS (SELECT a.id AS a, b.id AS b, b.w FROM f a JOIN f b ON abs(a.lat - b.lat) < 0.02 WHERE {t.HAVERSINE.format(a='a', b='b')} <= 1500),
  core AS (SELECT a AS id FROM pairs GROUP BY a HAVING sum(w) >= 3),
  edges AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
  reach AS (SELECT id, id AS r FROM core UNION SELECT reach.id, e.b FROM reach JOIN edges e ON e.a = reach.r),
  roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id),
  allroots AS (SELECT * FROM roots UNION ALL SELECT a, min(root) FROM pairs JOIN roots ON roots.id = pairs.b WHERE a NOT IN (SELECT id FROM core) GROUP BY a),
  numbers AS (SELECT root, CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS cluster FROM (SELECT DISTINCT root FROM roots)),
  db AS (SELECT p.id, p.lat, p.lon, cluster FROM points p JOIN f ON f.lat = p.lat AND f.lon = p.lon LEFT JOIN allroots r ON r.id = f.id LEFT JOIN numbers USING (root))"""

#: Exact hits ex (id, pos) and neighbours nn (id, score) as one result.
MERGED_HITS = """both_ AS (SELECT coalesce(ex.id, nn.id) AS id, pos, score, CASE WHEN pos IS NULL THEN 'semantic' WHEN score IS NULL THEN 'exact' ELSE 'both' END AS origin FROM ex FULL JOIN nn ON ex.id = nn.id),
  others AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM both_ WHERE pos IS NULL AND score >= 0),
  merged AS (SELECT id, origin, score, pos FROM both_ WHERE pos IS NOT NULL UNION ALL SELECT id, origin, score, pos FROM others WHERE n <= greatest({limit} - (SELECT count(*) FROM ex), 0))"""

#: Item by item: sums and counts of the clusters so far, and where each vector went.
_GREEDY = """v AS (SELECT vec_id AS id, embedding::FLOAT[]::DOUBLE[] AS x, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
  g AS (SELECT 0::BIGINT AS i, []::DOUBLE[][] AS sums, []::BIGINT[] AS counts, 0::BIGINT AS went
    UNION ALL SELECT i, CASE WHEN went > len(counts) THEN list_append(sums, x) ELSE list_transform(sums, lambda s, k: CASE WHEN k = went THEN list_transform(s, lambda a, j: a + x[j]) ELSE s END) END,
      CASE WHEN went > len(counts) THEN list_append(counts, 1) ELSE list_transform(counts, lambda c, k: CASE WHEN k = went THEN c + 1 ELSE c END) END, went
    FROM (SELECT i, x, sums, counts, CASE WHEN len(sims) > 0 AND list_max(sims) >= 0.3 THEN list_position(sims, list_max(sims)) ELSE len(counts) + 1 END::BIGINT AS went
      FROM (SELECT v.i, v.x, sums, counts, list_transform(sums, lambda s, k: list_cosine_similarity(list_transform(s, lambda a: (a / counts[k])::FLOAT::DOUBLE), v.x)) AS sims FROM g JOIN v ON v.i = g.i + 1))),
  last AS (SELECT sums, counts FROM g ORDER BY i DESC LIMIT 1),
  held AS (SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS cluster, list_transform(sums[k], lambda a: (a / counts[k])::FLOAT::DOUBLE) AS centre, counts[k] AS n FROM (SELECT sums, counts, unnest(range(1, len(counts) + 1)) AS k FROM last) WHERE counts[k] >= 3),
  members AS (SELECT v.id, cluster, list_cosine_similarity(centre, v.x) AS similarity, n FROM g JOIN v USING (i) JOIN held ON held.k = g.went)"""

#: Members of themes with the names of their clusters.
_NAMED = f"""{_WORDS.replace("SELECT doc_id AS id, lang AS cluster, unnest", "SELECT doc_id AS id, m.cluster, unnest").replace("FROM documents)", "FROM documents LEFT JOIN members m ON m.id = doc_id)")}, {_RANKED}, {_FORMS},
      tops AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS r FROM ranked WHERE cluster IS NOT NULL),
      l AS (SELECT cluster, string_agg(display, ' ' ORDER BY r) AS l FROM tops JOIN forms USING (cluster, term) WHERE r <= 3 GROUP BY cluster),
      k AS (SELECT cluster, 'theme:' || sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)) AS source_key, count(*) AS n FROM members GROUP BY cluster),
      themed AS (SELECT id, source_key, coalesce(upper(l[1]) || substring(l, 2), k.n || ' similar items') AS name, round(greatest(0, least(1, similarity)), 6) AS confidence FROM members JOIN k USING (cluster) LEFT JOIN l USING (cluster))"""

ORACLE_SQL = {
    "theme_clusters": f"WITH RECURSIVE {_GREEDY} SELECT id, cluster, round(similarity, 6) AS similarity FROM members",
    "theme_plan": f"""WITH RECURSIVE {_GREEDY}, {_NAMED}
      SELECT id AS item_id, source_key, name, confidence FROM themed""",
    "categorise_items": f"""WITH RECURSIVE {_DBSCAN.replace(t.POINTS, t.POINTS.replace("points AS (", "every AS (", 1) + ", points AS (SELECT * FROM every WHERE id % 7 <> 0)")}, {t.GAZETTEER}, {_GREEDY.replace("AS i FROM embeddings)", "AS i FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")}, {_NAMED},
      c AS (SELECT cluster, avg(lat) AS lat, avg(lon) AS lon FROM db WHERE cluster IS NOT NULL GROUP BY cluster),
      n AS (SELECT cluster, id, name, country, row_number() OVER (PARTITION BY cluster ORDER BY {t.HAVERSINE.format(a='c', b='g')}, id) AS r FROM c, gazetteer g),
      assigned AS (SELECT db.id, 'place' AS kind, 'place:' || n.id AS source_key, n.name || ', ' || country AS name, 0.9::DOUBLE AS confidence FROM db JOIN n USING (cluster) WHERE r = 1
        UNION ALL SELECT themed.id, 'theme', source_key, name, confidence FROM themed JOIN every USING (id))
      SELECT e.id, CASE WHEN l.toxic = 1 THEN 'error' WHEN a.id IS NOT NULL OR (e.lat IS NOT NULL AND e.id % 7 <> 0) OR x.vec_id IS NOT NULL THEN 'done' ELSE 'skipped' END AS status, kind, source_key, name, confidence
      FROM every e LEFT JOIN assigned a ON a.id = e.id LEFT JOIN labels l ON l.doc_id = e.id LEFT JOIN embeddings x ON x.vec_id = e.id""",
    "knn_cosine": f"SELECT id, round(score, 6) AS score FROM ({_KNN}) ORDER BY score DESC, id LIMIT 20",
    "knn_guarded_dim": f"SELECT id, round(score, 6) AS score FROM ({_KNN} WHERE e.label % 2 = 1 AND e.vec_id % 3 <> 0) ORDER BY score DESC, id LIMIT 15",
    "merge_exact_semantic": _bm25(["heat"]) + f""", ex AS (SELECT id, CAST(row_number() OVER (ORDER BY rank, capture_date DESC NULLS LAST, id DESC) AS INT) AS pos FROM found ORDER BY pos LIMIT 10),
      nn AS (SELECT id, score FROM ({_KNN}) ORDER BY score DESC, id LIMIT 30), {MERGED_HITS.format(limit=25)} SELECT id, origin, round(score, 6) AS score, pos FROM merged""",
    "embed_drain": """SELECT doc_id AS id, CASE WHEN full_ THEN 'done' ELSE 'skipped' END AS embed_status, CASE WHEN full_ THEN 64 END AS dim, CASE WHEN full_ THEN 1.0::DOUBLE END AS length
      FROM (SELECT doc_id, doc_id % 13 <> 0 AND coalesce(trim(text, ' '), '') || trim(concat_ws(' ', source, lang), ' ') <> '' AS full_ FROM documents)""",
    "passage_texts": f"WITH {t.ITEMS} SELECT id, md5('passage: ' || regexp_replace(concat_ws(chr(10), nullif(trim(description, ' '), ''), nullif(trim(search_meta, ' '), '')), '[\\r\\n]+', ' ', 'g')) AS passage_md5 FROM items",
    "haversine_pairs": f"WITH {t.GAZETTEER} SELECT * FROM (SELECT a.id AS a, b.id AS b, round({t.HAVERSINE.format(a='a', b='b')}, 3) AS d FROM gazetteer a JOIN gazetteer b ON a.id < b.id) WHERE d <= 1500000",
    "nearest_gazetteer": f"""WITH {t.POINTS}, {t.GAZETTEER}, p AS (SELECT a.id, b.id AS place_id, {t.HAVERSINE.format(a='a', b='b')} AS d FROM points a, gazetteer b)
      SELECT id, place_id, round(d, 3) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, place_id) AS r FROM p) WHERE r = 1""",
    "places_dbscan": f"WITH RECURSIVE {_DBSCAN} SELECT id, cluster FROM db",
    "places_centroids": f"WITH RECURSIVE {_DBSCAN} SELECT cluster, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM db WHERE cluster IS NOT NULL GROUP BY cluster",
    "places_plan": f"""WITH RECURSIVE {_DBSCAN}, {t.GAZETTEER}, c AS (SELECT cluster, avg(lat) AS lat, avg(lon) AS lon FROM db WHERE cluster IS NOT NULL GROUP BY cluster),
      n AS (SELECT cluster, id, name, country, row_number() OVER (PARTITION BY cluster ORDER BY {t.HAVERSINE.format(a='c', b='g')}, id) AS r FROM c, gazetteer g)
      SELECT db.id AS item_id, 'place:' || n.id AS source_key, n.name || ', ' || country AS name, 0.9::DOUBLE AS confidence, 'Near ' || n.name || ', ' || country || ' (from photo GPS)' AS explanation FROM db JOIN n USING (cluster) WHERE r = 1""",
    "theme_terms_tfdf": f"WITH {_WORDS}, {_RANKED} SELECT cluster, term, tf, df, round(score, 6) AS score FROM ranked",
    "theme_surface_forms": f"WITH {_WORDS}, {_FORMS} SELECT * FROM forms",
    "theme_labels": f"""WITH {_WORDS}, {_RANKED}, {_FORMS}, l AS (SELECT cluster, string_agg(display, ' ' ORDER BY r) AS l FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS r FROM ranked) JOIN forms USING (cluster, term) WHERE r <= 3 GROUP BY cluster)
      SELECT cluster, upper(l[1]) || substring(l, 2) AS label, 0.5::DOUBLE AS confidence FROM l""",
    "theme_source_key": "SELECT label AS cluster, 'theme:' || sha256(string_agg(vec_id::VARCHAR, chr(10) ORDER BY vec_id::VARCHAR)) AS source_key FROM embeddings GROUP BY label",
    "category_status_settle": f"""WITH {t.ITEMS} SELECT i.id, CASE WHEN l.toxic = 1 THEN 'error' WHEN l.quality = 1 OR i.id % 3 <> 0 THEN 'done' ELSE 'skipped' END AS status FROM items i LEFT JOIN labels l ON l.doc_id = i.id""",
}
