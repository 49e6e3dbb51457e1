"""Personal data: patterns propose spans, check digits confirm them, words near by move their score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which spans that start together are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "phone_local")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Only the start of a run of digits can start a match, and no run is given back: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![\w-])")

#: Words that raise or lower a kind's score where they stand near a span.
CONTEXT = {
    "email": (("email", "e-mail", "mail", "contact", "write"), ("example", "noreply")),
    "ip": (("ip", "host", "server", "address", "login"), ("version", "section", "release")),
    "card": (("card", "visa", "mastercard", "credit", "payment"), ("isbn", "order", "invoice")),
    "phone": (("phone", "tel", "call", "mobile", "fax", "whatsapp"), ("order", "invoice")),
    "iban": (("iban", "bank", "account", "bic", "transfer"), ("serial", "licence", "license", "part", "model", "order")),
    "phone_local": (("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "telefono", "téléphone", "teléfono"), ("order", "invoice", "isbn")),
}
#: Score of a span that its pattern proposed and its validator passed.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "phone_local": 0.3}
CONTEXT_CHARS = 40
CONTEXT_STEP = 0.25
#: The added kinds count only from this score on; base kinds count whatever their score is.
MIN_ADDED_SCORE = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of ISO 13616: the first four characters go last, letters count from 10."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the e-mail pattern finds, led by the rare '@' rather than by every letter.

    The part before '@' is the longest run of its characters that reaches it and does not reach back into
    the match before; a failing '@' is passed over, as the pattern would do.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        nxt = at + 1
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = nxt = m.end()
        at = text.find("@", nxt)


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
    words = set(re.findall(r"[\w-]+", around))
    up, down = CONTEXT[kind]
    score = BASE_SCORE[kind] + CONTEXT_STEP * (any(w in words for w in up) - any(w in words for w in down))
    return min(1.0, max(0.0, score))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in KINDS' order; offsets are code points, end exclusive.

    Base spans: leftmost non-overlapping matches of each kind's pattern that pass its validator; a failing
    match is dropped and not retried. Added: IBANs whose mod-97 check holds, and phone numbers without a
    country prefix which words near by speak for; the latter may not overlap a base span, the former only
    hold some. Null and empty: none.
    """
    if not text:
        return []
    found: list[tuple[str, int, int]] = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    base = sorted((s, e) for _, s, e in found)
    starts = [s for s, _ in base]
    # Spans of one kind do not overlap, so that those before a start end in order but for other kinds: the furthest end so far.
    furthest = list(accumulate((e for _, e in base), max))
    out = [(k, s, e, _score(k, text, s, e)) for k, s, e in found]
    for kind, pattern in (("iban", _IBAN), ("phone_local", _LOCAL_PHONE)):
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "iban" and not mod97(m[0].replace(" ", "")):
                continue
            if kind == "phone_local" and not 7 <= sum("0" <= c <= "9" for c in m[0]) <= 12:
                continue
            before, ahead = bisect_left(starts, e), bisect_left(starts, s)
            if kind == "iban":  # its check is the stronger one: base spans within it may stay beside it
                if before and furthest[before - 1] > e or ahead and furthest[ahead - 1] > s:
                    continue
            elif before and furthest[before - 1] > s:
                continue  # a base span overlaps
            score = _score(kind, text, s, e)
            if score >= MIN_ADDED_SCORE:
                out.append((kind, s, e, score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, score, value>>), a row for each row of docs."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "spans": [
                [{"kind": k, "start": s, "end": e, "score": p, "value": t[s:e]} for k, s, e, p in find(t)] for t in batch["text"]]})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind string, start int, end int, score double, value string>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<{}>") -> DataFrame:
    """docs with each span of its texts replaced by its kind; null texts stay null, other columns as they are."""
    def one(text):
        if not text:
            return text
        out, at = [], 0
        for kind, s, e, _ in find(text):
            if s >= at:
                out += [text[at:s], mark.format(kind)]
            at = max(at, e)
        return "".join([*out, text[at:]])

    clean = F.pandas_udf(lambda s: s.map(one), "string")
    return docs.withColumn(text_col, clean(F.col(text_col)))


def _listed(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in found)


def op7_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and their scores in the same order: a row for each row of docs.

    Null and empty texts have no span; texts of any length are read whole, in time linear in their length; rows
    without an id and repeated rows are scanned like any other; other columns are not looked at; an empty
    table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = find(text)
                base = [x for x in found if x[0] in KINDS[:4]]
                counts = [sum(x[0] == k for x in base) for k in KINDS[:4]]
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found), ",".join(f"{x[3]:.2f}" for x in found)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")
