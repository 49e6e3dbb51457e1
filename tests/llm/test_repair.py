import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from keepsake.llm import repair as r

SCHEMA = "conv_id long, turn long, role string, text string, copies string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
sys.setrecursionlimit(20_000)


def damage(rows):
    """The damaged rows in their order, by conversation."""
    out = {c: [] for c in {x[0] for x in rows}}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def cheapest(kinds):
    """(cost, audit) over the rows' (initial, must go, truncated): every state of the pattern, from the end backwards."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserts):
        ways = []
        if i == len(kinds) and last in ("", "a"):
            ways.append((0, ""))
        if inserts < 3:
            for role in follow[last].replace("s", ""):
                c, a = best(i, role, inserts + 1)
                ways.append((c + 2, "I" + a))
        if i < len(kinds):
            initial, gone, short = kinds[i]
            c, a = best(i + 1, last, 0)
            ways.append((c + 3, "D" + a))
            if not gone:
                if initial and initial in follow[last]:
                    c, a = best(i + 1, initial, 0)
                    ways.append((c + short, "K" + a))
                for role in follow[last].replace("s", ""):
                    c, a = best(i + 1, role, 0)
                    ways.append((c + 2 + short, "R" + a))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def expected(rows):
    out = {}
    for conv, held in damage(rows).items():
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in held:
            blank, dup = not WORD.search(text), (role, text) in seen
            short = not blank and not dup and WORD.findall(text)[-1] not in ".!?"
            seen.add((role, text))
            for i, x in enumerate((blank, dup and not blank, short)):
                counts[i] += x
            kinds.append((role[:1], blank or dup, int(short)))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        cost, audit = cheapest(tuple(kinds))
        lines, at, last = [], 0, ""
        for letter in audit:
            if letter == "I":
                last = "a" if last == "u" else "u"
                lines.append(f"{r.NAMES[last]}:")
                continue
            _, role, text = held[at]
            at += 1
            if letter == "K":
                lines.append(f"{role}:{text}")
                last = role[0]
            elif letter == "R":
                last = "a" if last == "u" else "u"
                lines.append(f"{r.NAMES[last]}:{text}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len(rows) == len({x[0] for x in rows})
    return {x[0]: tuple(x[1:]) for x in rows}


def conversations(rng, n, most=9):
    texts = ["Well.", "and so", "Yes!", "", " \t", "Why?", "no end, ", "A long one. ", "é.", ".\n"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            turn = None if rng.random() < 0.1 else rng.choice([t, t, t, t + 3, rng.randint(-2, 6)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"])
            rows.append((None if c == 0 else c, turn, role, rng.choice([*texts, None, f"{t}."])))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA).repartition(parts)


def test_search_equals_brute_force_and_stays_linear():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(0, 9)
        items = [(None, False, rng.randint(1, 2)) if rng.random() < 0.25 else (rng.choice("uuaasx"), rng.random() < 0.3, rng.choice([0, 0, 0, 2])) for _ in range(n)]
        kinds = []
        for initial, short, extra in items:
            kinds += ([] if initial is None else [(initial, False, int(short))]) + [("u", True, 0)] * extra
        cost, _, pieces, _ = r.search(items, r.START)
        assert (cost, "".join(pieces)) == cheapest(tuple(kinds))
    items = [(rng.choice("uas"), rng.random() < 0.3, 0) for _ in range(4000)]
    assert r.search(items, r.START)[3] < 6 * len(items)


def test_search_needs_no_exact_bounds(monkeypatch):
    """With bounds of zero the incumbent and the tables alone prove optimality."""
    rng = random.Random(2)
    monkeypatch.setattr(r, "bounds", lambda items, exits: [(0.0,) * 4] * len(items) + [tuple(exits)])
    for _ in range(200):
        items = [(rng.choice("uasx"), rng.random() < 0.3, 0) for _ in range(rng.randint(0, 6))]
        cost, _, pieces, _ = r.search(items, r.START)
        assert (cost, "".join(pieces)) == cheapest(tuple((i, False, int(t)) for i, t, _ in items))


@pytest.mark.parametrize("bits", [12, 1, 0])
def test_equals_brute_force(spark, monkeypatch, bits):
    """Blocks of 4096, of 2 and of 1 row give the same."""
    monkeypatch.setattr(r, "BLOCK_BITS", bits)
    rows = conversations(random.Random(3), 40) + [(900, t, "user", "Same.") for t in range(30)] + [(901, 5, "user", "Same again.")] * 30
    assert result(r.op12_repair(frame(spark, rows))) == expected(rows)


def test_empty_table(spark):
    assert r.op12_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_conversation_without_rows_left(spark):
    gone = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert gone and result(r.op12_repair(frame(spark, gone))) == {x[0]: nothing for x in gone}


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(r, "BLOCK_BITS", 5)
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{'x' * rng.randint(0, 3)} {t}{rng.choice(['.', ''])}") for t in range(300)] + conversations(rng, 5)
    assert result(r.op12_repair(frame(spark, rows))) == expected(rows)
