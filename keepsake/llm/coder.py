"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are renumbered to those it uses and cut into equal lanes, each with a range coder of its own; all
lanes take a step together and share one model, so a step is a few numpy operations over the lanes. The model
holds three predictions of the next id:

  order 2: the likeliest successors of the last two ids (a hash of them names a row), by their counts;
  order 1: the likeliest successors of the last id, by their counts;
  order 0: all ids of the block, by their counts.

They are mixed by weights: the coding range is shared out among the three, by how often each has served best so
far in the block where the two contexts were as well known as they are now (a state of 32 times 32 classes). An
id takes its interval in the prediction of the highest order that knows it. Counts and weights start anew in
each block, and are brought up to date after steps at growing distances (`_refreshes`); in between the model
stands still, so that a lane's prediction is a row to be looked up. All sums are of integers, so that they agree on
any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"KTB2"
_HEAD = struct.Struct("<4sIIIIIIII")
MAX_LANES, LANE_STEPS = 16384, 128
#: Ids of a block; longer documents go over several blocks.
BLOCK_IDS = 1 << 22

_U = np.uint64
_RANGE_BITS = 28
_FULL = 1 << _RANGE_BITS
_TOP = _U(1 << 31)
_LOW_MASK, _DIGIT_MASK = _U((1 << 31) - 1), _U((1 << 32) - 1)
_HASH_BITS, _COUNT_BITS = 18, 24
_COUNT_MASK = (1 << _COUNT_BITS) - 1
#: Successors that a row of order 2 and of order 1 names.
_ROW = (4, 16)
#: Order 0 keeps at least this part of the range, as it alone knows every id.
_LEAST = _FULL >> 6
_CLASSES = 32


def _refreshes(steps: int) -> set[int]:
    """Steps before which the model is brought up to date: after 1, 2, 4 and so on, up to a quarter of all."""
    out, at = set(), 1
    while at < steps and at <= max(1, steps // 4):
        out.add(at)
        at *= 2
    return out


def _merged(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sorted (key << _COUNT_BITS | count) of what was known and of the new keys."""
    keys = np.sort(np.concatenate((known, (keys << _COUNT_BITS) | 1)))
    if not len(keys):
        return keys
    key = keys >> _COUNT_BITS
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return (key[first] << _COUNT_BITS) | np.minimum(np.add.reduceat(keys & _COUNT_MASK, first), _COUNT_MASK)


def _count(flags: np.ndarray) -> np.ndarray:
    """Number of true flags in each row of 4 or of a multiple of 8 flags."""
    words = np.ascontiguousarray(flags).view(np.uint32 if flags.shape[1] == 4 else np.uint64)
    counts = np.bitwise_count(words)
    return (counts[:, 0] if words.shape[1] == 1 else sum(counts[:, k] for k in range(words.shape[1]))).astype(np.int64)


def _before(flags: np.ndarray) -> np.ndarray:
    """Number of flags before the only true one of each row; all of them where there is none."""
    words = np.ascontiguousarray(flags).view(np.uint32 if flags.shape[1] == 4 else np.uint64)
    # A flag is a byte: the bits below the lowest set one, in eights.
    zeros = np.bitwise_count(~words & (words - words.dtype.type(1))) >> 3
    place = zeros[:, -1]
    for k in range(words.shape[1] - 2, -1, -1):
        place = np.where(zeros[:, k] < words.dtype.itemsize, zeros[:, k], place + np.uint8(words.dtype.itemsize))
    return place.astype(np.int64)


class _Order:
    """Successor counts of one order, and the rows made of them: symbols, where their intervals start, and the end."""

    def __init__(self, contexts: int, row: int, id_bits: int, scale: int):
        self.row, self.cells, self.id_bits, self.scale = row, 2 * row + 1, id_bits, scale
        self.known = np.empty(0, np.int64)
        self.rows = np.full((contexts, self.cells), -1, np.int32)
        self.rows[:, row:] = 1 << scale
        self.grade = np.zeros(contexts, np.int16)

    def refresh(self, context: np.ndarray, ids: np.ndarray) -> None:
        self.known = _merged(self.known, (context << self.id_bits) | ids)
        count, key = self.known & _COUNT_MASK, self.known >> _COUNT_BITS
        ctx, sym = key >> self.id_bits, key & ((1 << self.id_bits) - 1)
        # By context, then by falling count, then by id.
        ranked = np.sort((ctx << (_COUNT_BITS + self.id_bits)) | ((_COUNT_MASK - count) << self.id_bits) | sym)
        ctx = ranked >> (_COUNT_BITS + self.id_bits)
        count = _COUNT_MASK - ((ranked >> self.id_bits) & _COUNT_MASK)
        first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
        size = np.diff(np.append(first, len(ctx)))
        place = np.arange(len(ctx)) - np.repeat(first, size)
        total, best = np.add.reduceat(count, first), count[first]
        much, sure = np.minimum(np.log2(total).astype(np.int64), 7), np.minimum(4 * best // (total + 1), 3)
        self.grade[ctx[first]] = 4 * much + sure
        held = place < self.row
        ctx, place, count = ctx[held], place[held], count[held]
        first = np.flatnonzero(place == 0)
        below = np.cumsum(count) - count
        size = np.diff(np.append(first, len(ctx)))
        whole = np.repeat(np.add.reduceat(count, first), size)
        cell = ctx * self.cells + place
        self.rows.ravel()[cell] = ranked[held] & ((1 << self.id_bits) - 1)
        self.rows.ravel()[cell + self.row] = ((below - np.repeat(below[first], size)) << self.scale) // whole

    def start_of(self, ids: np.ndarray, ctx: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id in its row's part of the range; width 0 where the row lacks it."""
        rows = self.rows.take(ctx, axis=0)
        place = _before(rows[:, :self.row] == ids.astype(np.int32)[:, None])
        lacks = np.flatnonzero(place == self.row)
        place[lacks] = 0
        cell = np.arange(self.row, rows.size, self.cells) + place
        flat = rows.ravel()
        start = (flat.take(cell) * share) >> self.scale
        width = ((flat.take(cell + 1) * share) >> self.scale) - start
        width[lacks] = 0
        return start, width

    def find(self, value: np.ndarray, ctx: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id at each value in its row's part of the range, and the id's start and width."""
        rows = self.rows.take(ctx, axis=0)
        place = _count(rows[:, self.row:-1] <= _mark(value, share, self.scale).astype(np.int32)[:, None]) - 1
        np.maximum(place, 0, out=place)  # only a damaged payload leads there
        cell = np.arange(0, rows.size, self.cells) + place
        flat = rows.ravel()
        start = (flat.take(cell + self.row) * share) >> self.scale
        return flat.take(cell), start, ((flat.take(cell + self.row + 1) * share) >> self.scale) - start


def _mark(value: np.ndarray, share: np.ndarray, scale: int) -> np.ndarray:
    """The largest bound below 2**scale which, scaled to the share, is not above the value."""
    return ((((value + 1) << scale) - 1).view(_U) // share.view(_U)).view(np.int64)


class _Model:
    """The three predictions, their weights, and what the lanes have seen since the last refresh."""

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.id_bits = max(1, alphabet.bit_length())
        self.scale = max(16, self.id_bits + 2)
        self.hash_mask = (1 << min(_HASH_BITS, 2 * self.id_bits)) - 1
        self.orders = (_Order(self.hash_mask + 1, _ROW[0], self.id_bits, self.scale), _Order(alphabet + 1, _ROW[1], self.id_bits, self.scale))
        self.count = np.zeros(alphabet, np.int64)
        self.used = np.ones((_CLASSES * _CLASSES, 3), np.int64)
        self.used[:, 2] = 4
        self.last = np.full(lanes, alphabet, np.int64)
        self.before = np.full(lanes, alphabet, np.int64)
        self.seen: list[tuple[np.ndarray, ...]] = []
        self._settle_order0()
        self._weigh()

    def _settle_order0(self) -> None:
        spare = (1 << self.scale) - self.alphabet
        width = 1 + self.count * spare // max(1, int(self.count.sum()))
        self.bound = np.concatenate(([0], np.cumsum(width)))
        self.slot = np.repeat(np.arange(self.alphabet), width)

    def _weigh(self) -> None:
        share = self.used * (_FULL - _LEAST) // self.used.sum(1, keepdims=True)
        self.share = [np.ascontiguousarray(share[:, k]) for k in (0, 1)]

    def contexts(self) -> None:
        """The contexts of the next step, and how the range is shared out there."""
        self.at = ((self.before * 0x2545F + self.last * 0x9E37) & self.hash_mask, self.last)
        self.state = self.orders[0].grade.take(self.at[0]).astype(np.int64) * _CLASSES + self.orders[1].grade.take(self.at[1])
        self.two, self.one = self.share[0].take(self.state), self.share[1].take(self.state)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's id in the whole range; notes which prediction served."""
        served = self.state * 3
        start, width = self.orders[0].start_of(ids, self.at[0], self.two)
        at = np.flatnonzero(width == 0)
        now, two, one = ids[at], self.two[at], self.one[at]
        s, w = self.orders[1].start_of(now, self.at[1][at], one)
        start[at], width[at] = s + two, w
        served[at] += 1
        still = np.flatnonzero(w == 0)
        at, now, base = at[still], now[still], two[still] + one[still]
        low, high = ((self.bound.take(now + i) * (_FULL - base)) >> self.scale for i in (0, 1))
        start[at], width[at] = base + low, high - low
        served[at] += 1
        self._note(ids, served)
        return start.view(_U), width.view(_U)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose interval holds each lane's value, and the interval."""
        served = self.state * 3
        ids, start, width = np.empty_like(value), np.empty_like(value), np.empty_like(value)
        above = value >= self.two
        at, rest = np.flatnonzero(~above), np.flatnonzero(above)
        ids[at], start[at], width[at] = self.orders[0].find(value[at], self.at[0][at], self.two[at])
        two, one = self.two[rest], self.one[rest]
        over = value[rest] - two
        above = over >= one
        some = np.flatnonzero(~above)
        at = rest[some]
        ids[at], s, width[at] = self.orders[1].find(over[some], self.at[1][at], one[some])
        start[at] = s + two[some]
        served[rest] += 1
        some = np.flatnonzero(above)
        at, base = rest[some], two[some] + one[some]
        now = self.slot.take(_mark(value[at] - base, _FULL - base, self.scale), mode="clip")
        low, high = ((self.bound.take(now + i) * (_FULL - base)) >> self.scale for i in (0, 1))
        ids[at], start[at], width[at] = now, base + low, high - low
        served[at] += 1
        if len(ids) and ids.min() < 0:
            raise ValueError("damaged token block")
        self._note(ids, served)
        return ids, start.view(_U), width.view(_U)

    def _note(self, ids: np.ndarray, served: np.ndarray) -> None:
        self.seen.append((self.at[0], self.at[1], ids, served))
        self.before, self.last = self.last, ids

    def refresh(self) -> None:
        two, one, ids, served = (np.concatenate(x) for x in zip(*self.seen, strict=True))
        self.seen = []
        self.count += np.bincount(ids, minlength=self.alphabet)
        self.used += np.bincount(served, minlength=self.used.size).reshape(self.used.shape)
        self.orders[0].refresh(two, ids)
        self.orders[1].refresh(one, ids)
        self._settle_order0()
        self._weigh()

    def keep(self, lanes: int) -> None:
        """Goes on with the first lanes alone: the last lanes are a step shorter."""
        self.last, self.before = self.last[:lanes], self.before[:lanes]


def _lanes(n: int) -> int:
    return max(1, min(MAX_LANES, n // LANE_STEPS))


def _grid(n: int, lanes: int) -> tuple[np.ndarray, int]:
    """Where each lane starts; the first n % lanes of them are one id longer."""
    size = np.full(lanes, n // lanes)
    size[: n % lanes] += 1
    return np.concatenate(([0], np.cumsum(size)[:-1])), int(size.max(initial=0))


def _steps(n: int, lanes: int, model: _Model):
    """(step, number of live lanes), with the model brought up to date and its contexts set."""
    steps = -(-n // lanes)
    due = _refreshes(steps)
    for t in range(steps):
        live = lanes if t < n // lanes else n % lanes
        if live < len(model.last):
            model.keep(live)
        if t in due:
            model.refresh()
        model.contexts()
        yield t, live


def compress(ids: np.ndarray, alphabet: int) -> tuple[int, bytes]:
    """Number of lanes and the coded payload of ids below `alphabet`.

    A lane's coder holds a 63-bit range. What leaves it goes out in digits of 32 bits; a carry stays on top
    of its digit until the end, when all are passed on at once.
    """
    n = len(ids)
    if not n:
        return 0, b""
    lanes = _lanes(n)
    starts, steps = _grid(n, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, 1 << 63, _U)
    # A step narrows a range by at most 2**28, so that it sends at most one digit.
    digits, used = np.zeros((steps + 2, lanes), _U), np.zeros(lanes, np.int64)
    model = _Model(alphabet, lanes)
    for t, live in _steps(n, lanes, model):
        start, width = model.interval(ids[starts[:live] + t].astype(np.int64))
        unit = span[:live] >> _U(_RANGE_BITS)
        a, b = low[:live], span[:live]
        a += start * unit
        np.multiply(width, unit, out=b)
        at = np.flatnonzero(b < _TOP)
        some = a[at]
        digits[used[at], at] = some >> _U(31)
        used[at] += 1
        a[at] = (some & _LOW_MASK) << _U(32)
        b[at] <<= _U(32)
    every = np.arange(lanes)
    digits[used, every] = (low + _LOW_MASK) >> _U(31)  # the one value with an end of zeros in each range
    used += 1
    digits = digits[:used.max()]
    for k in range(len(digits) - 1, 0, -1):
        digits[k - 1] += digits[k] >> _U(32)
    out = (digits & _DIGIT_MASK).astype("<u4").T
    return lanes, zlib.compress(used.astype("<u4").tobytes(), 1) + out[np.arange(out.shape[1])[None, :] < used[:, None]].tobytes()


def expand(payload: bytes, n: int, lanes: int, alphabet: int) -> np.ndarray:
    """The n ids of a payload."""
    if not n:
        return np.empty(0, np.int64)
    starts, _ = _grid(n, lanes)
    index = zlib.decompressobj()
    used = np.frombuffer(index.decompress(payload), "<u4").astype(np.int64)
    digits = np.concatenate((np.frombuffer(index.unused_data, "<u4").astype(_U), np.zeros(2, _U)))
    end = np.cumsum(used)
    place = end - used
    code, span = (digits[place] << _U(31)), np.full(lanes, 1 << 63, _U)
    place = place + 1
    # The second digit's upper bits complete the 63; past a lane's end come zeros.
    held = np.where(place < end, digits[np.minimum(place, len(digits) - 1)], _U(0))
    code, held, place = code | (held >> _U(1)), held & _U(1), place + 1
    out, model = np.empty(n, np.int64), _Model(alphabet, lanes)
    for t, live in _steps(n, lanes, model):
        a, b = code[:live], span[:live]
        unit = b >> _U(_RANGE_BITS)
        value = np.minimum(a // unit, _U(_FULL - 1)).view(np.int64)
        now, start, width = model.find(value)
        out[starts[:live] + t] = now
        a -= start * unit
        np.multiply(width, unit, out=b)
        at = np.flatnonzero(b < _TOP)
        where = place[at]
        nxt = np.where(where < end[at], digits[np.minimum(where, len(digits) - 1)], _U(0))
        a[at] = (a[at] << _U(32)) | (held[at] << _U(31)) | (nxt >> _U(1))
        held[at] = nxt & _U(1)
        place[at] += 1
        b[at] <<= _U(32)
    return out


def pack(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One block of (id or None, token ids): header, index of documents and of the ids in use, payload."""
    ids = np.concatenate([d for _, d in docs]).astype("<u4", copy=False) if docs else np.empty(0, "<u4")
    letters, coded = _renumbered(ids)
    lanes, payload = compress(coded, len(letters))
    keys = np.array([0 if k is None else k for k, _ in docs], "<i8")
    nulls = np.array([k is None for k, _ in docs], np.uint8)
    steps = np.diff(letters, prepend=0).astype("<u4")
    index = zlib.compress(keys.tobytes() + nulls.tobytes() + np.array([len(d) for _, d in docs], "<u4").tobytes() + steps.tobytes(), 6)
    body = index + payload
    return _HEAD.pack(MAGIC, len(ids), len(docs), lanes, len(letters), len(index), len(payload), zlib.crc32(body), zlib.crc32(ids)) + body


def _renumbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in use, ascending, and each id's place among them."""
    if not len(ids) or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    letters = np.flatnonzero(np.bincount(ids))
    number = np.zeros(int(letters[-1]) + 1, np.int32)
    number[letters] = np.arange(len(letters))
    return letters, number[ids]


def unpack(block: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a block; a damaged one is an error."""
    magic, n, n_docs, lanes, n_letters, n_index, n_payload, body_crc, ids_crc = _HEAD.unpack_from(block)
    body = block[_HEAD.size:]
    if magic != MAGIC or len(body) != n_index + n_payload or zlib.crc32(body) != body_crc or lanes != (_lanes(n) if n else 0):
        raise ValueError("damaged token block")
    index = zlib.decompress(body[:n_index])
    if len(index) != 13 * n_docs + 4 * n_letters:
        raise ValueError("damaged token block")
    keys, nulls = np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    ends = np.cumsum(np.frombuffer(index, "<u4", n_docs, 9 * n_docs), dtype=np.int64)
    letters = np.cumsum(np.frombuffer(index, "<u4", n_letters, 13 * n_docs), dtype=np.int64)
    ids = letters[expand(body[n_index:], n, lanes, n_letters)].astype("<u4") if n else np.empty(0, "<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("token block decodes to other ids")
    return [(None if z else int(k), ids[e - m:e]) for k, z, e, m in zip(keys, nulls, ends, np.diff(ends, prepend=0), strict=True)]
