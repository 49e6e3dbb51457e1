import io
import json
import shutil
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.catalog import Catalog
from keepsake.functions import dates
from keepsake.functions import text as X
from keepsake.log import Conflict, Log
from keepsake.sources import archives, chatlog, linkedin, social, zips
from keepsake.sources.lines import running
from keepsake.streaming import ingest


def lines(spark, text, file="c/WhatsApp Chat with Eva.txt"):
    return spark.createDataFrame([(file, i, v) for i, v in enumerate(text.split("\n"))], "file string, line_no long, value string")


CHAT = """stray line
‎[13/1/2021, 9:05:00] Eva: Hola
segunda línea

[2/3/2021, 9:06:00 PM] Max: ‎<attached: a.opus>
[2/3/2021, 21:07:00] Max: <attached: gone.jpg>
[3/3/2021, 21:07:00] Mensajes cifrados de extremo a extremo
[31/2/2021, 21:07:00] Eva: no such day"""


def test_chat_log(spark):
    files = spark.createDataFrame([("a.opus",)], "name string")
    kept, skipped = chatlog.read(lines(spark, CHAT), files)
    rows = sorted(kept.collect(), key=lambda r: int(r.sourceRef.split(":")[1]))
    assert [(r.author, r.mediaType, r.body) for r in rows][:2] == [("Eva", "message", "Hola\nsegunda línea"), ("Max", "audio", None)]
    assert [str(r.date.value)[:16] if r.date else None for r in rows] == ["2021-01-13 09:05", "2021-03-02 21:06", "2021-03-02 21:07", "2021-03-03 21:07", None]
    assert rows[3].author is None and json.loads(rows[0].sourceMeta)["chat"] == "Eva" and json.loads(rows[0].sourceMeta)["platform"] == "ios"
    assert sorted((r.ref, r.code) for r in skipped.collect()) == [("line:1", "E_PARSE"), ("msg:3", "E_ATTACHMENT_MISSING")]


def test_date_order_is_voted_as_the_log_goes_on(spark):
    text = "1/2/2021, 10:00 - A: x\n1/3/2021, 10:00 - A: x\n1/25/2021, 10:00 - A: y\n1/26/2021, 10:00 - A: z"
    got = chatlog.messages(lines(spark, text)).orderBy("index").collect()
    assert [r.order for r in got] == ["dmy", "mdy", "mdy", "mdy"] and {r.platform for r in got} == {"android"}


@pytest.mark.parametrize(("line", "want"), [
    ("[13/1/2021, 9:05:00] Eva: Hola", ("13/1/2021", "9:05:00", None, True, "Eva: Hola")), ("1/2/21, 10:00 - A: x", ("1/2/21", "10:00", None, False, "A: x")),
    ("13.1.2021 9.05 - A: x 7", ("13.1.2021", "9.05", None, False, "A: x 7")), ("2021-01-13, 9:05 p. m. - A: x", ("2021-01-13", "9:05", "p. m.", False, "A: x")),
    ("[1/2/21, 10:00:01 PM] A: x", ("1/2/21", "10:00:01", "PM", True, "A: x")), ("1/2/21 at 10:00: A", ("1/2/21", "10:00", None, False, "A")),
    ("1. 2. 2021, 10:00 - 5", ("1. 2. 2021", "10:00", None, False, "5")), ("12 apples and 3/4", None), ("1/2/21, 10:00", None), ("1/2/2021x 10:00 - A", None), ("", None), ("1/2/21, 10:00:305 - A", None)])
def test_headers(spark, line, want):
    r = spark.range(1).select(chatlog.header(F.lit(line)).alias("h")).first().h
    assert (r and (r.date, r.time, r.ampm, r.bracket, line[r.length:])) == want


@pytest.mark.parametrize(("body", "want"), [
    ("IMG-1.jpg (file attached)", ("IMG-1.jpg", None)), ("a b.pdf (\u200efile allegato\u200e)\ncaption", ("a b.pdf", "caption")), ("x.jpg (ficheiro anexado)", ("x.jpg", None)),
    ("x (Bestand bijgevoegd)", ("x", None)), ("My (final) report.pdf (Datei angehängt) see", ("My (final) report.pdf", "see")), ("two apples (each)", (None, "two apples (each)")),
    ("<attached: a.opus>", ("a.opus", None)), ("<adjunto: e\u0301.jpg> hi", ("é.jpg", "hi")), ("(file attached)", (None, "(file attached)")), ("<b>", (None, "<b>")), ("no\nname (file attached)", (None, "no\nname (file attached)"))])
def test_attachments(spark, body, want):
    file, caption = chatlog.attachment(F.lit(body))
    assert tuple(spark.range(1).select(file, caption).first()) == want


def test_folding_and_composing(spark):
    words = ["Việt Nam", "Viê\u0323t", "ΆΛΦΑ", "Ёлка йод", "Straße øre", "naïve-café"]
    got = [r.t for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.tokens(F.col("w")).alias("t")).collect()]
    assert got == [["viet", "nam"], ["viet"], ["αλφα"], ["елка", "иод"], ["straße", "øre"], ["naive", "cafe"]]
    assert [X.fold_text(w).split() for w in words[:2]] == got[:2]
    assert spark.range(1).select(X.nfc(F.lit("e\u0301a"))).first()[0] == "éa"


def test_csv():
    assert linkedin.parse_csv('﻿a,"b ""q"", c"\r\n"x\ny",\n') == [["a", 'b "q", c'], ["x\ny", ""]]
    for bad in ('"open', "a\0b"):
        with pytest.raises(ValueError, match="quote|NUL"):
            linkedin.parse_csv(bad)


def test_linkedin(spark):
    files = [("x/messages.csv", 'CONVERSATION ID,FROM,DATE,CONTENT\n1,Ana,2020-01-31 10:20:30 UTC,"Hi, you\nthere"\n,,,\n'),
             ("x/Connections.csv", '﻿Notes:\n"a preamble"\n\nFirst Name,Last Name,Company,Position,Connected On\nJosé,Pérez,"Acme, Inc",Dev,31 Jan 2020\n'),
             ("x/Rich_Media.csv", "Time,Media Link\n1/31/20,http://l\n"), ("x/other.csv", "a,b\n"), ("y/messages.csv", "no,header\n")]
    kept, skipped = linkedin.read(spark.createDataFrame(files, "file string, text string"))
    got = {r.sourceRef: (r.author, r.body, str(r.date.value)) for r in kept.collect()}
    assert got == {"messages.csv#1": ("Ana", "Hi, you\nthere", "2020-01-31 10:20:30"), "Connections.csv#4": ("José Pérez", "Dev at Acme, Inc", "2020-01-31 00:00:00"), "Rich_Media.csv#1": (None, "http://l", "2020-01-31 00:00:00")}
    assert sorted((r.ref.split("#")[0], r.code) for r in skipped.collect()) == [("messages.csv", "E_PARSE")] * 2


def test_facebook(spark):
    posts = [{"timestamp": 1577836800, "data": [{"post": "JosÃ©"}], "attachments": [{"data": [{"media": {"uri": "m/a.jpg", "creation_timestamp": 1577836801, "description": "d"}}]}]}, 42, {"timestamp": 1577836802}]
    entries = spark.createDataFrame([("root/m/a.jpg",), ("root/n/b.mp4",)], "path string")
    kept, skipped = social.facebook_posts(spark.createDataFrame([("p.json", json.dumps(posts))], "file string, text string"), entries)
    assert sorted((r.sourceRef, r.mediaType, r.body) for r in kept.collect()) == [("p.json#0:media:0", "photo", "d"), ("p.json#0:text", "message", "José"), ("p.json#2:text", "message", None)]
    assert [(r.ref, r.code) for r in skipped.collect()] == [("p.json#1", "E_PARSE")]
    album = {"name": "Verano", "photos": [{"uri": "n/b.mp4", "creation_timestamp": 5}, {"uri": "none.jpg"}]}
    kept, skipped = social.facebook_albums(spark.createDataFrame([("a.json", json.dumps(album))], "file string, text string"), entries)
    assert [(r.mediaType, r.originalPath) for r in kept.collect()] == [("video", "root/n/b.mp4")] and skipped.count() == 1


def test_threads(spark):
    thread = {"title": "T", "participants": [{"name": "A"}], "messages": [{"sender_name": "A", "timestamp_ms": 1000, "content": "x", "photos": [{"uri": "m/a.jpg"}]}, {"sender_name": "B", "timestamp_ms": 2000}, 7]}
    files = spark.createDataFrame([("r/messages/inbox/t/message_1.json", json.dumps(thread)), ("messages/elsewhere/t/message_1.json", json.dumps(thread)), ("r/messages/inbox/u/message_1.json", "[]")], "file string, text string")
    kept, skipped = social.messenger(files, spark.createDataFrame([("m/a.jpg",)], "path string"))
    assert sorted((r.sourceRef.split("#")[1], r.mediaType, r.author) for r in kept.collect()) == [("0:photos:0", "photo", "A"), ("0:text", "message", "A"), ("1:text", "message", "B")]
    assert skipped.count() == 2 and {r.sourceType for r in kept.collect()} == {"messenger"} and social.instagram(files)[0].count() == 2


def test_telegram(spark):
    chat = {"name": "N", "type": "personal_chat", "id": 9, "messages": [
        {"id": 1, "type": "message", "date_unixtime": "1600000000", "from": "A", "text": ["a", {"type": "bold", "text": "b"}, [{"text": ["c"]}]]},
        {"id": 1, "type": "message", "from": "A", "text": "again"}, {"id": 2, "type": "service", "text": ""},
        {"id": 3, "type": "message", "date": "2020-09-13T12:26:40", "from": "B", "text": "", "photo": "photos/p.jpg"}, {"id": 4, "type": "message", "text": "t", "file": "../x.jpg"}]}
    for text in (json.dumps(chat), json.dumps({"chats": {"list": [chat]}})):
        kept, skipped = social.telegram(spark.createDataFrame([("r.json", text)], "file string, text string"))
        rows = {r.sourceRef: r for r in kept.collect()}
        assert rows["message:1"].body == "abc" and str(rows["message:1"].date.value) == str(rows["message:3"].date.value) == "2020-09-13 12:26:40"
        assert rows["message:3:media:photos/p.jpg"].mediaType == "photo" and len(rows) == 4
        assert sorted(r.code for r in skipped.collect()) == ["E_MEDIA_PATH", "E_SERVICE_MESSAGE"]


def test_apple_messages(spark):
    t = lambda schema, rows: spark.createDataFrame(rows, schema)
    args = (t("ROWID long, guid string, text string, date long, is_from_me int, handle_id long, service string", [(1, "g1", "hi", 600000000000000000, 0, 1, "iMessage"), (2, "g2", None, 600000000, 1, None, "SMS"), (3, "g3", None, None, 0, 1, "SMS")]),
            t("ROWID long, id string", [(1, "+1")]), t("ROWID long, guid string, display_name string", [(1, "c1", None), (2, "c2", "Two")]), t("chat_id long, message_id long", [(2, 1), (1, 1)]),
            t("ROWID long, filename string, mime_type string, transfer_name string", [(5, "~/Library/Messages/Attachments/a/b.jpg", "image/jpeg", "b.jpg"), (6, "~/Library/Messages/Attachments/../x.jpg", None, None)]), t("message_id long, attachment_id long", [(2, 5), (2, 6)]))
    kept, skipped = archives.imessage(*args)
    rows = {r.sourceRef: r for r in kept.collect()}
    assert rows["message:1"].author == "+1" and json.loads(rows["message:1"].sourceMeta)["chatGuids"] == ["c1", "c2"] and str(rows["message:1"].date.value).startswith("2020-01-06")
    assert rows["message:2:attachment:5"].originalPath == "a/b.jpg" and rows["message:2:attachment:5"].author == "Me" and len(rows) == 2
    assert sorted((r.ref, r.code) for r in skipped.collect()) == [("message:2:attachment:6", "E_ATTACHMENT_PATH"), ("message:3", "E_EMPTY_MESSAGE")]


def test_mail(spark):
    box = "From a@b Thu\nFrom: A <a@b.co>\nDate: Mon, 13 Jan 2020 10:00:00 +0100\nSubject: S\n\nhello\n>From here\n>>From there\nFrom x\nno headers here\n"
    kept, skipped = archives.mbox(lines(spark, box, "m.mbox"))
    (row,) = kept.collect()
    assert row.body == "hello\nFrom here\n>From there" and str(row.date.value) == "2020-01-13 09:00:00" and json.loads(row.sourceMeta)["subject"] == "S"
    assert skipped.count() == 1


def test_photos_and_sidecars(spark):
    media = spark.createDataFrame([("d", n, None) for n in ("a.jpg", "b(1).jpg", "verylongname_full.jpg", "x.png", "notes.xyz")], "dir string, name string, modified timestamp")
    side = json.dumps({"photoTakenTime": {"timestamp": "1600000000"}, "geoData": {"latitude": 0.0, "longitude": 0.0}, "description": "hey"})
    jsons = spark.createDataFrame([("d", "a.jpg.json", side), ("d", "b.jpg(1).json", json.dumps({"creationTime": {"timestamp": "5"}, "geoData": {"latitude": 1.5, "longitude": 2.0, "altitude": 7.0}})), ("d", "verylongname.json", "broken"), ("d", "very.json", side), ("e", "x.png.json", side)], "dir string, json string, text string")
    pairs = {r.name: r.sidecar for r in archives.sidecars(media, jsons).collect()}
    assert pairs == {"a.jpg": "a.jpg.json", "b(1).jpg": "b.jpg(1).json", "verylongname_full.jpg": "verylongname.json", "x.png": None, "notes.xyz": None}
    rows = {r.sourceRef: r for r in archives.photos(media, jsons).collect()}
    assert len(rows) == 4 and rows["d/a.jpg"].gps is None and rows["d/a.jpg"].body == "hey" and rows["d/b(1).jpg"].gps.alt == 7.0 and rows["d/x.png"].date is None


def test_folders_zips_and_gazetteers(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/p.JPG").write_bytes(b"x")
    (tmp_path / "in/q.unknown").write_bytes(b"x")
    kept, _ = archives.folder(archives.listing(spark, str(tmp_path / "in")), f"file:{tmp_path}/in")
    assert [(r.sourceRef, r.mediaType, r.date.source) for r in kept.collect()] == [("sub/p.JPG", "photo", "mtime")]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.txt", "hello")
        z.writestr("../evil.txt", "x")
        z.writestr("bomb.txt", "0" * 1_000_000)
    (tmp_path / "a.zip").write_bytes(raw.getvalue())
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    entries, skipped = zips.unzip(spark, f"{tmp_path}/*.zip")
    assert [(r.path, bytes(r.content)) for r in entries.collect()] == [("ok.txt", b"hello")] and sorted(r.code for r in skipped.collect()) == ["E_BAD_ZIP", "E_RATIO", "E_ZIP_SLIP"]
    assert zips.has_entry(str(tmp_path / "a.zip"), ("ok",)) and archives.select_source(["x/result.json"]) == "telegram" and archives.select_source(["x.jpg"]) == "folder"
    (tmp_path / "g.ndjson").write_text('{"id": 1, "name": "A", "lat": 1.0, "lon": 2.0}\nbroken\n{"id": 2, "name": "B", "lat": 91.0, "lon": 2.0}\n')
    good, bad = archives.gazetteer(spark, str(tmp_path / "g.ndjson"))
    assert good.count() == 1 and bad.count() == 2
    (tmp_path / "t.tsv").write_text("\n".join("\t".join([str(i), f" n{i} ", "", "", "1.0", "2.0", "", "", "US", "", "TX", "", "", "", str(p)]) for i, p in ((1, 5), (2, 9), (3, 9))))
    assert [r.id for r in archives.pack_gazetteer(spark, str(tmp_path / "t.tsv"), 2).collect()] == [2, 3]


@pytest.mark.parametrize(("raw", "want"), [("2020-02-30", None), ("2020-02-29", "2020-02-29"), ("Feb 3, 2021", "2021-02-03"), ("3 Feb 2021", "2021-02-03"), ("2/3/21", "2021-02-03"), ("13/13/2021", None), ("2020-01-31T10:20Z", "2020-01-31"), ("2020-01-31 10:20:30   utc", "2020-01-31"), ("2020-1-31", None), ("2020-01-31 10", None), ("31 Foo 2020", None), ("31 Jan 20", None), ("Jan 31 2020", "2020-01-31"), ("January 31, 2020", "2020-01-31"), ("1/31/020", None), ("UTC", None), ("2020-01-31 X", None), ("soon", None), ("", None), (None, None)])
def test_linkedin_dates(spark, raw, want):
    got = spark.range(1).select(F.date_format(dates.linkedin_date(F.lit(raw).cast("string")), "yyyy-MM-dd")).first()[0]
    assert got == want


def test_streaming_equals_batch_and_survives_replay(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit("message").alias("mediaType"), F.lit(None).cast("string").alias("originalPath"), "text", "source", "doc_id")
    for i in range(3):
        docs.filter(F.col("doc_id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = "mediaType string, originalPath string, text string, source string, doc_id long"
    make = lambda d: ingest.item_rows(d.select("mediaType", "originalPath", F.col("text").alias("body"), F.col("source").alias("author"), F.lit(None).cast("struct<value: timestamp, source: string>").alias("date"), F.col("doc_id").alias("seq")))
    path = f"{tmp_path}/in/*"
    for _ in range(2):
        ingest.ingest(spark, path, schema, f"{tmp_path}/out", f"{tmp_path}/ck", make).awaitTermination()
    once = ingest.latest(spark, f"{tmp_path}/out")
    assert once.count() == docs.select("text").distinct().count() and Log(spark, f"{tmp_path}/out/_log").last() == 3
    before = sorted(map(str, once.collect()))
    # The last batch's entry was made, but the stream does not know: it is run again, and changes nothing.
    shutil.rmtree(f"{tmp_path}/ck/commits")
    ingest.ingest(spark, path, schema, f"{tmp_path}/out", f"{tmp_path}/ck", make).awaitTermination()
    assert Log(spark, f"{tmp_path}/out/_log").last() == 3
    assert sorted(map(str, ingest.latest(spark, f"{tmp_path}/out").collect())) == before


ITEM = "id string, media_type string, description string, search_meta string, capture_date string, content_hash string, seq long"


def test_a_small_batch_touches_few_buckets(spark, tmp_path):
    folder = f"{tmp_path}/items"
    row = lambda i, text: (f"i{i}", "message", text, f"t{i}", None, f"h{i}", i)
    run = ingest.merge_batch(folder, buckets=64)
    run(spark.createDataFrame([row(i, f"text {i}") for i in range(2000)] + [("n1", "photo", None, None, None, None, 5000), ("n2", "photo", None, None, None, None, 5001)], ITEM), 0)
    first = Log(spark, f"{folder}/_log").newest()[1]
    run(spark.createDataFrame([("other", "message", "later", f"x{i}", "2020", f"h{i}", i) for i in range(9)] + [("n3", "photo", None, None, None, None, 1)], ITEM), 1)
    second = Log(spark, f"{folder}/_log").newest()[1]
    assert len(second["touched"]) <= 10 and sum(first["files"][b] != second["files"][b] for b in first["files"]) == len(second["touched"])
    got = {r.id: r for r in ingest.latest(spark, folder).collect()}
    assert len(got) == 2003 and {"n1", "n2", "n3"} <= got.keys()
    assert (got["i3"].description, got["i3"].search_meta, got["i3"].capture_date) == ("text 3", "t3 x3", "2020")
    run(spark.createDataFrame([row(1, "again")], ITEM), 1)  # a batch that is known by its number
    assert Log(spark, f"{folder}/_log").last() == 2


def test_of_two_writers_one_is_told(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log")
    log.append(1, {"a": 1})
    with pytest.raises(Conflict):
        log.append(1, {"a": 2})
    assert log.newest() == (1, {"a": 1})
    one, other = Catalog.create(spark, f"{tmp_path}/c"), Catalog.open(spark, f"{tmp_path}/c")
    rows = spark.createDataFrame([("i", "p")], "item_id string, text string")
    at = one.version("transcripts")
    whole = rows.selectExpr("item_id", "text", "null language", "null segments")
    other.save("transcripts", whole, at)
    with pytest.raises(Conflict):
        one.save("transcripts", whole, at)
    assert one.version("transcripts") == at + 1 and one.load("transcripts").count() == 1


LONG_CHAT = "".join(f"[{d:02d}/{m:02d}/2021, 10:{d:02d}:00] Ana: line {d} {m}\r\nmore of {d}\r\n" if (d + m) % 3 else f"{d}\n" for m in range(1, 13) for d in range(1, 29))


@pytest.mark.parametrize("size", [400, 4000, 1 << 20])
def test_lines_and_messages_are_the_same_however_a_file_is_split(spark, tmp_path, size, monkeypatch):
    (tmp_path / "chat.txt").write_bytes(LONG_CHAT.encode())
    (tmp_path / "short.txt").write_bytes(b"one\n\ntwo")
    monkeypatch.setattr("keepsake.sources.lines.PIECE_BITS", 4)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        read = chatlog.read_lines(spark, f"{tmp_path}/*.txt")
        got = sorted((r.file.rsplit("/", 1)[-1], r.line_no, r.value) for r in read.collect())
        kept = chatlog.messages(read).orderBy("index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [("chat.txt", i, v) for i, v in enumerate(LONG_CHAT.replace("\r", "").split("\n")[:-1])] + [("short.txt", i, v) for i, v in enumerate(("one", "", "two"))]
    assert got == want
    heads = [v for _, _, v in want if v.startswith("[")]
    assert [r["index"] for r in kept] == list(range(1, len(heads) + 1)) and all(r.body.startswith("line") for r in kept) and sum(r.body.count("\n") + 1 for r in kept) == len(want) - 3


def test_running_sums_equal_a_window_over_all(spark, monkeypatch):
    monkeypatch.setattr("keepsake.sources.lines.PIECE_BITS", 2)
    rows = spark.createDataFrame([("ab"[i % 2], i * 3 % 101, i % 5) for i in range(101)], "file string, line_no long, v long")
    for ahead in (False, True):
        got = {(r.file, r.line_no): r.s for r in running(rows, {"s": F.col("v")}, ahead=ahead).collect()}
        plain = F.sum("v").over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, int(ahead)))
        assert got == {(r.file, r.line_no): r.s for r in rows.withColumn("s", plain).collect()}


@pytest.mark.parametrize(("body", "out"), [("<Media omitted>", True), ("\u200eimage omitted", True), ("imagen omitida", True), ("<Mídia oculta>", True), ("I omitted the image", False), ("omitted", False), ("oculto", False), ("", False), (None, None)])
def test_notes_of_media_left_out(spark, body, out):
    assert bool(spark.range(1).select(chatlog._left_out(F.lit(body).cast("string"))).first()[0]) == bool(out)


def test_zip_entries_are_refused_before_they_are_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"d/f{i}.txt", f"text {i}" * 50)
        z.writestr("empty.txt", "")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "/etc/passwd")
        z.writestr("C:/abs.txt", "x")
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("zeros", "w", force_zip64=True) as f:
        for _ in range(300):
            f.write(bytes(1 << 20))
    data = bytearray((tmp_path / "many.zip").read_bytes())
    at = data.index(b"text 7" * 2) if b"text 7" * 2 in data else data.index(b"d/f7.txt") + 12
    data[at:at + 4] = b"\xff\xff\xff\xff"
    (tmp_path / "spoilt.zip").write_bytes(data)
    parts, skipped = zips.unzip(spark, f"{tmp_path}/*.zip")
    got = {(r.archive.rsplit("/", 1)[-1], r.path): bytes(r.content) for r in parts.collect()}
    assert {k: v for k, v in got.items() if k[0] == "many.zip"} == {("many.zip", f"d/f{i}.txt"): f"text {i}".encode() * 50 for i in range(40)} | {("many.zip", "empty.txt"): b""}
    assert ("spoilt.zip", "d/f7.txt") not in got and ("spoilt.zip", "d/f8.txt") in got
    codes = sorted((r.ref.rsplit("/", 1)[-1], r.code) for r in skipped.collect())
    assert ("bomb.zip!zeros", "E_RATIO") in codes and ("many.zip!link", "E_SYMLINK") in codes and ("abs.txt", "E_ZIP_SLIP") in codes and ("f7.txt", "E_BAD_ENTRY") in codes
    assert {r.code for r in zips.unzip(spark, f"{tmp_path}/many.zip", entries=3)[1].collect()} == {"E_TOO_MANY_ENTRIES"}
    assert "E_TOO_LARGE" in {r.code for r in zips.unzip(spark, f"{tmp_path}/many.zip", totalBytes=1000)[1].collect()}


def test_parts_of_a_large_entry(spark, tmp_path):
    body = bytes(range(256)) * 4096 * 20
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("big.bin", body)
    parts = sorted((r.part, bytes(r.content)) for r in zips.unzip(spark, f"{tmp_path}/a.zip")[0].collect())
    assert len(parts) == 2 and b"".join(p for _, p in parts) == body
    before = zips._names.cache_info().hits
    assert zips.has_entry(f"{tmp_path}/a.zip", ("big",)) and not zips.has_entry(f"{tmp_path}/a.zip", ("small",)) and zips._names.cache_info().hits > before
