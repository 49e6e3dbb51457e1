import random
import re
from collections import Counter

import numpy as np
import pytest

from keepsake.llm import repetition as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup, chars = text.split("\n"), set(), 0, 0
    for line in lines:
        if WORD.search(line):
            if line in seen:
                dup, chars = dup + 1, chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    out = []
    for n in (3, 5, 10):
        windows = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        times, first = Counter(windows), {}
        every, later = set(), set()
        for i, w in enumerate(windows):
            if times[w] > 1:
                every |= set(range(i, i + n))
                if first.setdefault(w, i) != i:
                    later |= set(range(i, i + n))
        out.append((len(every), sum(len(words[i]) for i in later)))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, out[0][0], *[x for _, x in out], chars)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "one", "a b c", "a b c a b c", "x " * 60, "é ü　z | #", "same line here\n" * 30, "\n\n a\n a\n"]
    for _ in range(200):
        words = [rng.choice(["aa", "é", "ß|", "c#", "dddd", "#"]) for _ in range(rng.randint(1, 90))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n"]) for w in words))
    return out


def test_measures_equal_brute_force():
    for text in texts():
        assert q.measure(text) == slow(text)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(q, "shingle_hashes", lambda ids, n: np.zeros(len(ids) - n + 1, np.uint64))
    for text in texts()[:60]:
        assert q.measure(text) == slow(text)


def test_verdicts(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage = words(40)
    docs = {1: words(60), 2: words(49), 3: "a b c " * 40, 4: words(60) + "\n" + (passage + "\n") * 2, 5: " | ".join(words(60).split()), 6: words(200) + " " + passage + " " + words(20) + " " + passage, 7: None, 8: ""}
    rows = [(k, v, "x") for k, v in docs.items()] + [(None, docs[1], "x"), (1, docs[1], "x")]
    got = [(r.doc_id, r.base_failed, r.kept) for r in q.op13_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted([(1, False, True), (1, False, True), (None, False, True), (2, True, False), (3, True, False), (4, True, False) if 100 * slow(docs[4])[4] > 50 * slow(docs[4])[0] else (4, False, False),
                                           (5, False, False), (6, False, True), (7, True, False), (8, True, False)], key=str)


def test_empty_table_and_long_text(spark):
    assert q.op13_quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{i % 70001}" for i in range(300_000))
    row = q.op13_quality_rules(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert row.n_words == 300_000 and row.base_failed and row.chars_10 > row.word_chars // 2


@pytest.mark.parametrize("text", ["a a a", "b a a b a a"])
def test_overlapping_windows(text):
    assert q.measure(text) == slow(text)
