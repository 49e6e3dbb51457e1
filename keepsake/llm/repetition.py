"""Quality rules: how much of a text lies inside n-grams and lines that it has said before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import encode, mix, shingle_hashes

#: Words of an n-gram, and the percentage of a text's characters that may lie inside n-grams seen earlier in it.
LIMITS = {3: 30, 5: 25, 10: 20}
#: The same of whole lines.
LINE_LIMIT = 30
#: Words of the base rule's window, the percentage of words that may lie in repeated ones, and the fewest words.
WINDOW, WINDOW_LIMIT, LEAST_WORDS = 3, 50, 50
#: Percentage of symbols for each word.
SYMBOL_LIMIT = 10
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"chars_{n}" for n in LIMITS), "chars_lines")


def _classes(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of n words: how many windows equal it, and whether one of them starts earlier.

    Windows meet by a rolling hash. Each is compared with the first of its hash, word by word; should two
    different ones have met, the windows themselves are sorted.
    """
    _, first, group, times = np.unique(shingle_hashes(mix(words.astype(np.uint64)), n), return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[group] > 1)
    lead = first[group[again]]
    if any((words[again + i] != words[lead + i]).any() for i in range(n)):
        windows = np.lib.stride_tricks.sliding_window_view(words, n)
        _, first, group, times = np.unique(windows, axis=0, return_index=True, return_inverse=True, return_counts=True)
        group = group.ravel()
    return times[group], first[group] != np.arange(len(group))


def _inside(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in a window of n that starts at one of `starts`."""
    step = np.zeros(size + 1, np.int64)
    step[starts] += 1
    step[starts + n] -= 1
    return np.cumsum(step)[:size] > 0


def measure(text: str | None) -> tuple[int, ...]:
    """The values of COLUMNS for a text; null is empty, and all are 0 for it.

    chars_n are the code points of words inside n-grams that occur earlier in the text, each counted once;
    chars_lines those of lines that equal an earlier line. n_repeat_words counts the first occurrence too.
    """
    buf = encode(text)
    raw = np.frombuffer(buf, np.uint8)
    words: list[bytes] = []
    lines: set[bytes] = set()
    again: list[tuple[int, int]] = []
    for line in buf.split(b"\n"):
        if own := line.split():
            if line in lines:
                again.append((len(words), len(words) + len(own)))
            lines.add(line)
            words += own
    size = len(words)
    if not size:
        return (0, 0, int(_IS_SYMBOL[raw].sum()), *(0,) * (len(COLUMNS) - 3))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, size)
    # Code points of a word are its bytes less those that continue one.
    lengths = np.fromiter(map(len, known), np.int64, len(known))
    joined = np.frombuffer(b"".join(known), np.uint8)
    lengths = np.add.reduceat((joined & 0xC0) != 0x80, np.concatenate(([0], np.cumsum(lengths)[:-1])), dtype=np.int64)[ids]
    repeated, covered = 0, []
    for n in sorted({WINDOW, *LIMITS}):
        later = np.zeros(size, bool)
        if size > n:
            times, earlier = _classes(ids, n)
            later = _inside(np.flatnonzero(earlier), n, size)
            if n == WINDOW:
                repeated = int(_inside(np.flatnonzero(times > 1), n, size).sum())
        if n in LIMITS:
            covered.append(int(lengths[later].sum()))
    before = np.concatenate(([0], np.cumsum(lengths)))
    return (size, int(before[-1]), int(_IS_SYMBOL[raw].sum()), len(again), repeated, *covered, int(sum(before[b] - before[a] for a, b in again)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COLUMNS...) for each row of docs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measure(t) for t in batch["text"]], columns=list(COLUMNS), dtype="int64")
            out.insert(0, "id", batch["id"])
            yield out

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, ", ".join(["id long", *(f"{c} long" for c in COLUMNS)]))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured() with base_failed, and kept: neither the base rule nor a limit on repetition or symbols is broken.

    All comparisons are between whole numbers. Null, empty and very short texts fail the base rule; very long
    texts are measured whole; a row without an id keeps its row; repeated rows repeat; an empty table gives an
    empty result; other columns are not looked at.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > WINDOW_LIMIT * F.col("n_words"))
    broken = (100 * F.col("chars_lines") > LINE_LIMIT * F.col("word_chars")) | (100 * F.col("n_symbols") > SYMBOL_LIMIT * F.col("n_words"))
    for n, most in LIMITS.items():
        broken = broken | (100 * F.col(f"chars_{n}") > most * F.col("word_chars"))
    return measured(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~base & ~broken)


def op13_quality_rules(docs: DataFrame) -> DataFrame:
    """Each document's measures and verdict: a row for each row of docs, as judged() says."""
    return judged(docs).withColumnRenamed("id", "doc_id")


#: The same in SQL.
ORACLE = r"""WITH lines AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
      held AS (SELECT doc_id, i, ws, i > min(i) OVER (PARTITION BY doc_id, line) AS again FROM lines WHERE len(ws) > 0),
      by_line AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, sum(CASE WHEN again THEN len(array_to_string(ws, '')) ELSE 0 END) AS chars_lines FROM held GROUP BY doc_id),
      texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM texts),
      windows AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (
        SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM texts, (SELECT unnest([3, 5, 10]) AS n) WHERE len(ws) >= n)),
      hits AS (SELECT doc_id, n, p, count(*) OVER k > 1 AS repeated, p > min(p) OVER k AS later FROM windows WINDOW k AS (PARTITION BY doc_id, n, k)),
      inside AS (SELECT doc_id, n, p + o AS p, bool_or(repeated) AS repeated, bool_or(later) AS later FROM hits, (SELECT unnest(range(0, 10)) AS o) WHERE o < n AND repeated GROUP BY ALL),
      covered AS (SELECT doc_id, count(*) FILTER (n = 3 AND repeated) AS n_repeat_words, coalesce(sum(len(word)) FILTER (n = 3 AND later), 0) AS chars_3,
        coalesce(sum(len(word)) FILTER (n = 5 AND later), 0) AS chars_5, coalesce(sum(len(word)) FILTER (n = 10 AND later), 0) AS chars_10 FROM inside JOIN words USING (doc_id, p) GROUP BY doc_id),
      every AS (SELECT doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(chars_3, 0) AS chars_3, coalesce(chars_5, 0) AS chars_5,
        coalesce(chars_10, 0) AS chars_10, coalesce(chars_lines, 0) AS chars_lines FROM texts LEFT JOIN by_line USING (doc_id) LEFT JOIN covered USING (doc_id)),
      based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM every)
      SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
        chars_3::BIGINT AS chars_3, chars_5::BIGINT AS chars_5, chars_10::BIGINT AS chars_10, chars_lines::BIGINT AS chars_lines, base_failed,
        NOT base_failed AND 100 * chars_lines <= 30 * word_chars AND 100 * n_symbols <= 10 * n_words AND 100 * chars_3 <= 30 * word_chars AND 100 * chars_5 <= 25 * word_chars
        AND 100 * chars_10 <= 20 * word_chars AS kept FROM based"""
