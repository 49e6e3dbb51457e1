import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.catalog import Catalog
from keepsake.operators import filters, search
from keepsake.sources import probes


def jpeg(order=">", taken=b"2020:01:31 10:20:30\0"):
    """A JPEG front with a date, an orientation and a place at 33.5 S, 70.25 W."""
    h = lambda f, *v: struct.pack(order + f, *v)
    data, exif, gps = 8 + 2 + 3 * 12 + 4, 300, 400
    body = bytearray(700)
    body[:8] = (b"MM" if order == ">" else b"II") + h("HI", 42, 8)
    body[8:data] = h("H", 3) + h("HHIHH", 0x0112, 3, 1, 6, 0) + h("HHII", 0x8769, 4, 1, exif) + h("HHII", 0x8825, 4, 1, gps) + h("I", 0)
    body[exif:exif + 18] = h("H", 1) + h("HHII", 0x9003, 2, 20, 350) + h("I", 0)
    body[350:350 + len(taken)] = taken
    tags = h("HHI4s", 1, 2, 2, b"S\0\0\0") + h("HHII", 2, 5, 3, 500) + h("HHI4s", 3, 2, 2, b"W\0\0\0") + h("HHII", 4, 5, 3, 550)
    body[gps:gps + 2 + len(tags)] = h("H", 4) + tags
    body[500:524], body[550:574] = h("6I", 33, 1, 30, 1, 0, 1), h("6I", 70, 1, 15, 1, 0, 1)
    return b"\xff\xd8\xff\xe1\x00\x00Exif\0\0" + bytes(body)


@pytest.mark.parametrize("order", [">", "<"])
def test_exif(order):
    e = probes.read_exif(jpeg(order))
    assert str(e["taken"]) == "2020-01-31 10:20:30" and (e["lat"], e["lon"], e["orientation"]) == (-33.5, -70.25, 6)
    assert probes.read_exif(jpeg(order, b"not a date at all...\0"))["taken"] is None
    for bad in (b"", b"Exif\0\0", jpeg(order)[:40], jpeg(order).replace(b"Exif", b"none")):
        assert probes.read_exif(bad) is None or isinstance(probes.read_exif(bad), dict)


def test_wav_and_probe(spark, tmp_path):
    wav = b"RIFF" + struct.pack("<I", 36 + 16000) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 16000) + bytes(16000)
    assert probes.wav_seconds(wav) == 1.0 and probes.wav_seconds(b"x") is None
    (tmp_path / "a.jpg").write_bytes(jpeg())
    (tmp_path / "b.wav").write_bytes(wav)
    rows = {r.path[-5:]: r for r in probes.probe(spark, str(tmp_path)).collect()}
    assert rows["a.jpg"].lat == -33.5 and rows["a.jpg"].seconds is None and rows["b.wav"].seconds == 1.0


def test_catalog_versions(spark, tmp_path):
    made = Catalog.create(spark, f"{tmp_path}/c", "mine")
    with pytest.raises(FileExistsError):
        Catalog.create(spark, f"{tmp_path}/c")
    with pytest.raises(FileNotFoundError):
        Catalog.open(spark, f"{tmp_path}/none")
    row = spark.createDataFrame([("k", "theme", "n", None)], "id string, kind string, name string, source_key string")
    assert made.load("categories").count() == 0 and made.save("categories", row) == 2
    row.union(row).write.parquet(f"{tmp_path}/c/categories/v=3")  # left behind by a job that failed
    assert Catalog.open(spark, f"{tmp_path}/c").load("categories").count() == 1


def test_smart_search_filters_after_neighbours(spark):
    items = spark.createDataFrame([(1, None, "cat here", None, None, "message"), (2, None, "dog", None, None, "message"), (3, None, "bird", None, None, "audio")], "id long, title string, description string, search_meta string, capture_date string, media_type string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1])], "id long, vector array<float>")
    embed = lambda texts: np.array([[1.0, 0.0]])
    got = search.smart_search(items, vectors, "cat", embed, 2).orderBy(F.col("pos").asc_nulls_last(), F.col("score").desc()).collect()
    assert [(r.id, r.origin) for r in got] == [(1, "exact"), (2, "semantic")]
    audio = search.smart_search(items, vectors, "cat", embed, 1, lambda i: filters.by_type(i, ["audio"]))
    assert audio.count() == 0  # the one neighbour is no audio
    def broken(texts):
        raise RuntimeError("no model")
    assert [r.id for r in search.smart_search(items, vectors, "cat", broken, 5).collect()] == [1]


def test_index_refresh_and_small_filters(spark):
    schema = "id long, title string, description string, search_meta string"
    old = spark.createDataFrame([(1, None, "red", None), (2, None, "blue", None)], schema)
    new = spark.createDataFrame([(1, None, "green", None)], schema)
    index = search.refreshed(search.postings(old), new, spark.createDataFrame([(2,)], "id long"))
    assert [(r.token, r.id) for r in index.collect()] == [("green", 1)]
    assert [r.id for r in filters.by_ids(old, "[2, 99]").collect()] == [2] and filters.by_ids(old, "[]").count() == 0
    t = spark.createDataFrame([(1, "done"), (2, "done"), (3, "error")], "id long, transcript_status string")
    got = {r.id: (r.status, r.text) for r in filters.transcripts_of(t, spark.createDataFrame([(1, "x", "en"), (3, "y", "en")], "item_id long, text string, language string")).collect()}
    assert got == {1: ("done", "x"), 2: ("pending", None), 3: ("error", None)}
    assert [r.id for r in filters.pending(t.withColumn("s", F.lit("pending")), "s", 2).collect()] == [1, 2]
