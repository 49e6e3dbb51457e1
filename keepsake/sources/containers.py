"""Duration and size of media files, from the parts of their containers that say so. Nothing is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Parts below parts that are gone into, parts that are looked at in one file, and bytes of MP3 tags that may come first.
DEPTH, PARTS = 8, 20_000

# Fixed values of the formats: MP4 boxes that hold boxes; Matroska's element ids; MPEG audio's tables.
_HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts"}
_SEGMENT, _INFO, _SCALE, _DURATION, _TRACKS, _TRACK, _VIDEO, _WIDTH, _HEIGHT = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0xE0, 0xB0, 0xBA
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_KBITS = {(3, 1): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (3, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
          (3, 3): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)}
_LOW_KBITS = {1: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
              3: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)}

Found = dict[str, float | int | str | None]


def _boxes(data: memoryview, at: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes between two places, those inside holders included."""
    while at + 8 <= end:
        (size,) = struct.unpack_from(">I", data, at)
        kind, head = bytes(data[at + 4:at + 8]), 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        if kind in _HOLDERS and depth < DEPTH:
            yield from _boxes(data, at + head, at + size, depth + 1)
        at += size


def _mp4(data: memoryview) -> Found:
    seconds, width, height = None, None, None
    for n, (kind, at, end) in enumerate(_boxes(data, 0, len(data))):
        if n > PARTS:
            break
        if kind == b"mvhd":
            form = ">II" if data[at] == 0 else ">IQ"
            scale, length = struct.unpack_from(form, data, at + (12 if data[at] == 0 else 20))
            if scale and length not in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):
                seconds = length / scale
        elif kind == b"tkhd":
            w, h = struct.unpack_from(">II", data, end - 8)
            if w and h and width is None:
                width, height = w >> 16, h >> 16
                a, b = struct.unpack_from(">ii", data, end - 44)
                if a == 0 and b:  # a quarter turn
                    width, height = height, width
    return {"seconds": seconds, "width": width, "height": height}


def _vint(data: memoryview, at: int, marked: bool) -> tuple[int, int]:
    """(value, length) of a variable-length number; its length mark is kept for ids."""
    first = data[at]
    if not first:
        raise ValueError("number is too long")
    length = 9 - first.bit_length()
    value = int.from_bytes(data[at:at + length], "big")
    return (value if marked else value & ((1 << (7 * length)) - 1)), length


def _elements(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        key, a = _vint(data, at, True)
        size, b = _vint(data, at + a, False)
        start = at + a + b
        stop = end if size == (1 << (7 * b)) - 1 else min(end, start + size)
        yield key, start, stop
        at = stop


def _matroska(data: memoryview) -> Found:
    scale, length, width, height, n = 1_000_000, None, None, None, 0
    for key, at, end in _elements(data, 0, len(data)):
        if key != _SEGMENT:
            continue
        for part, a, b in _elements(data, at, end):
            n += 1
            if n > PARTS or part == 0x1F43B675:  # clusters: the media themselves
                break
            if part == _INFO:
                for k, x, y in _elements(data, a, b):
                    if k == _SCALE:
                        scale = int.from_bytes(data[x:y], "big")
                    elif k == _DURATION:
                        (length,) = struct.unpack(">f" if y - x == 4 else ">d", data[x:y])
            elif part == _TRACKS:
                for _, x, y in (e for e in _elements(data, a, b) if e[0] == _TRACK):
                    for _, v, w in (e for e in _elements(data, x, y) if e[0] == _VIDEO):
                        for k, s, t in _elements(data, v, w):
                            if k == _WIDTH and width is None:
                                width = int.from_bytes(data[s:t], "big")
                            elif k == _HEIGHT and height is None:
                                height = int.from_bytes(data[s:t], "big")
    return {"seconds": None if length is None else length * scale / 1e9, "width": width, "height": height}


def _ogg(data: memoryview) -> Found:
    """From the rate in the first page and the last page's position."""
    head, rate, skip = bytes(data[:512]), None, 0
    if (at := head.find(b"OpusHead")) >= 0:
        rate, skip = 48_000, struct.unpack_from("<H", head, at + 10)[0]
    elif (at := head.find(b"\x01vorbis")) >= 0:
        (rate,) = struct.unpack_from("<I", head, at + 12)
    tail = bytes(data[-70_000:])
    last, at = None, len(tail)
    while rate and last is None and (at := tail.rfind(b"OggS", 0, at)) >= 0:
        if at + 14 <= len(tail):
            (place,) = struct.unpack_from("<q", tail, at + 6)
            last = place if place >= 0 else None
    return {"seconds": max(0, last - skip) / rate if last is not None else None, "width": None, "height": None}


def _mp3(data: memoryview) -> Found:
    """From the frame count of a Xing, Info or VBRI header, else from the first frame's bit rate."""
    at = 0
    if bytes(data[:3]) == b"ID3":
        at = 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True)) + (10 if data[5] & 16 else 0)
    end = len(data) - (128 if bytes(data[-128:-125]) == b"TAG" else 0)
    limit = min(end - 4, at + 65_536)
    while at < limit:
        (head,) = struct.unpack_from(">I", data, at)
        version, layer, bits, rate = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
        if head >> 21 == 0x7FF and version != 1 and layer and 0 < bits < 15 and rate < 3:
            break
        at += 1
    else:
        return {}
    hertz, mono = _RATES[version][rate], head >> 6 & 3 == 3
    kbits = (_KBITS[3, layer] if version == 3 else _LOW_KBITS[layer])[bits]
    samples = 384 if layer == 3 else 1152 if layer == 2 or version == 3 else 576
    first = bytes(data[at:at + 200])
    for mark, offset in ((b"Xing", None), (b"Info", None), (b"VBRI", 14)):
        where = first.find(mark)
        if where >= 0:
            if offset is None and not struct.unpack_from(">I", first, where + 4)[0] & 1:
                continue
            (frames,) = struct.unpack_from(">I", first, where + (8 if offset is None else offset))
            return {"seconds": frames * samples / hertz, "width": None, "height": None, "channels": 1 if mono else 2}
    return {"seconds": (end - at) * 8 / (kbits * 1000), "width": None, "height": None, "channels": 1 if mono else 2}


def _picture(data: memoryview) -> Found:
    head = bytes(data[:32])
    size = None
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        size = struct.unpack_from(">II", head, 16)
    elif head[:6] in (b"GIF87a", b"GIF89a"):
        size = struct.unpack_from("<HH", head, 6)
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        if head[12:16] == b"VP8X":
            size = tuple(int.from_bytes(head[i:i + 3], "little") + 1 for i in (24, 27))
        elif head[12:16] == b"VP8 ":
            size = tuple(x & 0x3FFF for x in struct.unpack_from("<HH", head, 26))
        elif head[12:16] == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            size = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
    elif head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                size = struct.unpack_from(">HH", data, at + 5)[::-1]
                break
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return {} if size is None else {"seconds": None, "width": size[0], "height": size[1]}


def _wav(data: memoryview) -> Found:
    at, rate = 12, None
    while at + 8 <= len(data):
        name, (size,) = bytes(data[at:at + 4]), struct.unpack_from("<I", data, at + 4)
        if name == b"fmt " and at + 20 <= len(data):
            (rate,) = struct.unpack_from("<I", data, at + 16)
        if name == b"data":
            return {"seconds": min(size, len(data) - at - 8) / rate if rate else None, "width": None, "height": None}
        at += 8 + size + size % 2
    return {}


def container(content: bytes) -> str | None:
    """Which container a file's first bytes tell of."""
    head = bytes(content[:16])
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        return "mp4"
    for name, mark in (("matroska", b"\x1a\x45\xdf\xa3"), ("ogg", b"OggS"), ("png", b"\x89PNG"), ("gif", b"GIF8"), ("jpeg", b"\xff\xd8")):
        if head.startswith(mark):
            return name
    if head[:4] == b"RIFF":
        return {b"WAVE": "wav", b"WEBP": "webp"}.get(head[8:12])
    if head[:3] == b"ID3" or len(head) > 1 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0:
        return "mp3"
    return None


_READERS = {"mp4": _mp4, "matroska": _matroska, "ogg": _ogg, "wav": _wav, "mp3": _mp3}


def measure(content: bytes) -> Found:
    """container, seconds, width and height of a file; None for what it does not say. Broken files say what they can; none fails."""
    kind = container(content)
    out: Found = {"container": kind, "seconds": None, "width": None, "height": None}
    if kind:
        try:
            out |= _READERS.get(kind, _picture)(memoryview(content))
        except (struct.error, ValueError, IndexError, ZeroDivisionError):
            pass
    return out
