"""Text expressions: folding, search tokens, bounds, repairs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

def _bases(last: int) -> dict[str, str]:
    """Letters up to a code point that stand for a letter and marks, by the letter."""
    found = {}
    for c in map(chr, range(0xC0, last)):
        whole = unicodedata.normalize("NFD", c)
        if len(whole) > 1 and whole[0].isalnum() and all(unicodedata.combining(m) for m in whole[1:]):
            found[c] = whole[0]
    return found


_BASES = _bases(0x3000)
_MARKED, _PLAIN = "".join(_BASES), "".join(_BASES.values())
WORD = r"[\p{L}\p{N}]+"
#: A word as it is written, with combining marks.
WRITTEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def fold(text: Column) -> Column:
    """Lower case without diacritics, composed or combining; letters that do not decompose (ß, ø) stay."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, _MARKED, _PLAIN), r"\p{M}+", "")).otherwise(low)


def spellings(letter: str) -> set[str]:
    """The letters with marks that fold to a letter."""
    return {c for c, base in _BASES.items() if base == letter}


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def fold_text(text: str) -> str:
    low = text.lower().translate(str.maketrans(_MARKED, _PLAIN))
    return "".join(c for c in low if not unicodedata.category(c).startswith("M"))


def nfc(text: Column) -> Column:
    """Unicode's composed form; Spark has no function for it, so Arrow batches go through Python."""
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return F.pandas_udf(compose, "string")(text)


def query_terms(raw: str) -> list[list[str]]:
    """The phrases of a search: white-space separated, without those that hold no letter or digit.

    A phrase is a run of adjacent tokens of which the last one is a prefix; all phrases have to be found.
    """
    found = [re.findall(r"[^\W_]+", fold_text(t)) for t in raw.split()]
    return [t for t in found if t]


def has_content(raw: str) -> bool:
    return bool(query_terms(raw))


def merge_tokens(*parts: Column) -> Column:
    """Union of white-space separated tokens in order of first sight; nulls count as empty."""
    words = [F.split(F.coalesce(p, F.lit("")), r"\s+") for p in parts]
    return F.array_join(F.array_remove(F.array_distinct(F.concat(*words)), ""), " ")


def register(spark: SparkSession) -> None:
    """Makes merge_tokens(existing, incoming) a function of the session's SQL, with the expression of merge_tokens()."""
    words = lambda c: f"split(coalesce({c}, ''), '\\\\s+')"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION merge_tokens(existing STRING, incoming STRING) RETURNS STRING DETERMINISTIC "
              f"RETURN array_join(array_remove(array_distinct(concat({words('existing')}, {words('incoming')})), ''), ' ')")


def merge_token_lists(lists: Column) -> Column:
    """The same over an array of token strings."""
    words = F.flatten(F.transform(lists, lambda p: F.split(F.coalesce(p, F.lit("")), r"\s+")))
    return F.array_join(F.array_remove(F.array_distinct(words), ""), " ")


def search_tokens(path: Column, author: Column) -> Column:
    """Base name and author, what there is of them; null if there is neither."""
    both = F.concat_ws(" ", F.nullif(F.substring_index(path, "/", -1), F.lit("")), author)
    return F.nullif(both, F.lit(""))


def bounded(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def repair_mojibake(text: Column) -> Column:
    """UTF-8 bytes that were read as Latin-1 characters, put right; anything else stays as it is."""
    raw = F.encode(F.when(text.rlike(r"^[\x00-\xff]*$") & text.rlike(r"[\x80-\xff]"), text), "ISO-8859-1")
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


def highlight(text: Column, term: str, start: str = "[", end: str = "]") -> Column:
    """Non-overlapping occurrences of the term, in any case, between marks; an empty term marks nothing."""
    if not term:
        return text
    return F.regexp_replace(text, F.lit("(?i)" + re.escape(term)), F.lit(f"{start}$0{end}"))


def safe_segment(name: Column) -> Column:
    """A name that can stand as one segment of a path."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[\\/:*?\"<>|\x00-\x1f]", "_"), r"^\.+|\.+$", "")
    return F.coalesce(F.nullif(F.trim(clean), F.lit("")), F.lit("untitled"))


def header_name(cell: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(cell)), r"\s+", " ")


def unescape_mbox(line: Column) -> Column:
    return F.regexp_replace(line, "^>(>*From )", "$1")


def iso_utc(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def duration_label(seconds: Column) -> Column:
    """m:ss."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def month_label(moment: Column) -> Column:
    return F.date_format(moment, "MMMM yyyy")


def coordinate_label(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f, %.4f", lat, lon)


def wer_words(text: Column) -> Column:
    """Words for word error rates: lower case, no marks but apostrophes within."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s']", " ")
    return F.array_remove(F.split(F.trim(clean), r"\s+"), "")
