import random
import time

from keepsake.operators import speech
from keepsake.plans import imports


def plain(reference, heard):
    """The whole table, cell by cell: substitutions first among equals, then deletions."""
    rows = [[(j, 0, 0, j) for j in range(len(heard) + 1)]]
    for i, word in enumerate(reference, 1):
        row = [(i, 0, i, 0)]
        for j, other in enumerate(heard, 1):
            c, s, d, n = rows[-1][j - 1]
            best = (c, s, d, n) if word == other else (c + 1, s + 1, d, n)
            c, s, d, n = rows[-1][j]
            best = (c + 1, s, d + 1, n) if c + 1 < best[0] else best
            c, s, d, n = row[j - 1]
            row.append((c + 1, s, d, n + 1) if c + 1 < best[0] else best)
        rows.append(row)
    return rows[-1][-1][1:]


def test_align_against_the_whole_table():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(15))] for _ in range(2))
        assert speech.align(a, b) == plain(a, b)


def test_large_tables_keep_some_columns(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(speech, "TABLE_BYTES", 0)
    for _ in range(150):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(40))] for _ in range(2))
        assert speech.align(a, b) == plain(a, b)


def test_long_texts_align_in_bounded_time():
    rng = random.Random(6)
    a = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    b = [w for w in a if rng.random() > 0.1]
    began = time.time()
    subs, dels, inserts = speech.align(a, b)
    assert dels - inserts == len(a) - len(b) and subs + dels + inserts <= len(a) - len(b) and time.time() - began < 30


def test_the_query_takes_whole_turns(spark, tmp_path):
    rng = random.Random(4)
    turns = [" ".join(rng.choice(["uno", "dos", "tres", "four", "five"]) for _ in range(n)) for n in (5, 200, 310, 90, 0, 40)]
    turns[2] = turns[1] + " " + turns[2]  # alike in the first 300 characters
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.words, r.substitutions, r.deletions, r.insertions) for r in imports.wer(spark, str(tmp_path)).collect()}
    assert got == {i: (len(turns[i].split()), *plain(turns[i].split(), turns[i - 1].split())) for i in range(1, 6)}
