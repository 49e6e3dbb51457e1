import struct

import pytest

from keepsake.sources import probes
from keepsake.sources.containers import container, measure


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def mp4(seconds=12.5, size=(1920, 1080), turned=False, version=0):
    head = struct.pack(">B3xIIII", 0, 0, 0, 1000, int(seconds * 1000)) if not version else struct.pack(">B3xQQIQ", 1, 0, 0, 1000, int(seconds * 1000))
    matrix = struct.pack(">9i", *((0, 1 << 16, 0, -(1 << 16), 0, 0, 0, 0, 1 << 30) if turned else (1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)))
    track = struct.pack(">B3xIIIII", 0, 0, 0, 1, 0, 0) + bytes(16) + matrix + struct.pack(">II", size[0] << 16, size[1] << 16)
    sound = track[:-8] + bytes(8)
    return box(b"ftyp", b"isom0000") + box(b"mdat", bytes(50)) + box(b"moov", box(b"mvhd", head + bytes(80)) + box(b"trak", box(b"tkhd", sound)) + box(b"trak", box(b"tkhd", track)))


def element(key, body):
    return bytes.fromhex(key) + (0x4000 | len(body)).to_bytes(2, "big") + body


def matroska():
    info = element("1549a966", element("2ad7b1", (1_000_000).to_bytes(3, "big")) + element("4489", struct.pack(">d", 3500.0)))
    video = element("e0", element("b0", (640).to_bytes(2, "big")) + element("ba", (360).to_bytes(2, "big")))
    return element("1a45dfa3", b"") + element("18538067", info + element("1654ae6b", element("ae", video)) + element("1f43b675", bytes(20)))


def ogg(head, place):
    page = lambda at, body: b"OggS" + struct.pack("<BBqIIIB", 0, 0, at, 1, 0, 0, 1) + bytes([len(body)]) + body
    return page(0, head) + page(place, b"x" * 20) + page(-1, b"y")


def mp3(header=b""):
    frame = struct.pack(">I", 0xFFFB9064) + bytes(32) + header
    return b"ID3\x04\0\0\0\0\0\x0a" + bytes(10) + frame.ljust(417, b"\0") + (struct.pack(">I", 0xFFFB9064).ljust(417, b"\0")) * 99


@pytest.mark.parametrize(("content", "want"), [
    (mp4(), ("mp4", 12.5, 1920, 1080)), (mp4(turned=True), ("mp4", 12.5, 1080, 1920)), (mp4(3.0, version=1), ("mp4", 3.0, 1920, 1080)), (matroska(), ("matroska", 3.5, 640, 360)),
    (ogg(b"OpusHead\x01\x02" + struct.pack("<HIHB", 312, 44100, 0, 0), 48_000 * 4 + 312), ("ogg", 4.0, None, None)),
    (ogg(b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44_100) + bytes(14), 44_100 * 3), ("ogg", 3.0, None, None)),
    (mp3(), ("mp3", pytest.approx(100 * 417 * 8 / 128_000), None, None)), (mp3(b"Xing" + struct.pack(">II", 1, 200)), ("mp3", pytest.approx(200 * 1152 / 44_100), None, None)),
    (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 20) + bytes(9), ("png", None, 30, 20)), (b"GIF89a" + struct.pack("<HH", 7, 9), ("gif", None, 7, 9)),
    (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little") + bytes(4), ("webp", None, 100, 50)),
    (b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 11, 22) + bytes(8), ("jpeg", None, 22, 11)),
    (b"plain text", (None, None, None, None)), (b"", (None, None, None, None))])
def test_containers(content, want):
    m = measure(content)
    assert (m["container"], m["seconds"], m["width"], m["height"]) == want


@pytest.mark.parametrize("whole", [mp4(), matroska(), mp3(), ogg(b"OpusHead\x01\x02" + bytes(9), 9999)])
def test_broken_files_do_not_fail(whole):
    for n in range(0, len(whole), 7):
        assert measure(whole[:n])["container"] in (None, container(whole))
        assert isinstance(measure(whole[:n] + b"\xff" * 16 + whole[n + 16:]), dict)


def test_probe_and_real_time_factor(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(mp4())
    (tmp_path / "b.mkv").write_bytes(matroska())
    (tmp_path / "c.txt").write_bytes(b"hello")
    rows = {r.path[-5:]: (r.container, r.seconds, r.width, r.height) for r in probes.probe(spark, str(tmp_path)).collect()}
    assert rows == {"a.mp4": ("mp4", 12.5, 1920, 1080), "b.mkv": ("matroska", 3.5, 640, 360), "c.txt": (None, None, None, None)}
    audio = spark.createDataFrame([("a", 12.5), ("b", 0.0)], "id string, seconds double")
    took = spark.createDataFrame([("a", 2500), ("b", 10), ("x", 10)], "id string, ms long")
    assert {r.id: r.rtf for r in probes.real_time_factor(audio, took).collect()} == {"a": 0.2, "b": None, "x": None}
