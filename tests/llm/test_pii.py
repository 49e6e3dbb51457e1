import hashlib
import re
import time

from keepsake.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "phone" and 9 <= len(digits) <= 15)
            if kind == "card":
                d = [int(c) for c in reversed(digits)]
                ok = 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(PATTERNS).index(x[0])))


HARD = ["", None, "a@b", "x.y@@c.de", "a@b.c@d.e f@g.h", "me@mail.example.com.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.4 9.9.9.99999999999999", "4111 1111 1111 1111-2", "4111-1111-1111-1111",
        "+1 (555) 010-9999 +4", "++49 30 1234567", "é😀 a@b.co 😀", "@a.b", "a@-.-", "0" * 5000, "1 " * 3000, "x" * 3000 + "@" + "y" * 10 + ".z"]


def test_base_spans_equal_the_patterns():
    for text in HARD:
        assert [x[:3] for x in pii.find(text) if x[0] in PATTERNS] == brute(text), text


def test_added_spans_need_a_valid_number_or_a_word_near_by():
    assert [x[0] for x in pii.find("IBAN DE89 3704 0044 0532 0130 00 please")] == ["iban"]
    assert pii.find("IBAN DE88 3704 0044 0532 0130 00 please") == []
    assert [x[0] for x in pii.find("call 030 1234 5678 now")] == ["phone_local"] and pii.find("sum 030 1234 5678 now") == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.op7_pii(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == b[0] for b in base) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(filter(None, r.spans.split(",")))


def test_nulls_repeats_redaction_and_empty(spark):
    docs = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, None), (3, "")], "doc_id long, text string").selectExpr("*", "'s' AS spans")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.op7_pii(docs).collect()) == [(0, 0), (1, 1), (1, 1), (3, 0)]
    assert sorted(str(r.text) for r in pii.redact(docs).collect()) == ["", "<email>", "<email>", "None"]
    assert pii.op7_pii(docs.limit(0)).count() == 0 and pii.spans(docs).count() == 4


def test_very_long_texts_take_linear_time():
    for text in ("1" * 1_000_000, "1." * 500_000, "a" * 1_000_000, "a@" * 300_000, "+1 " * 300_000, "DE89 " * 200_000, "4111 1111 1111 1111 x " * 20_000, "030 1234 5678 call " * 20_000):
        began = time.process_time()
        found = pii.find(text)
        assert time.process_time() - began < 30
        assert [x[:3] for x in found if x[0] in PATTERNS] == sorted((x[:3] for x in found if x[0] in PATTERNS), key=lambda x: x[1])
    assert len(pii.find("1.2.3.4 " * 1000)) == 1000 and len(pii.find("1" * 3000 + ".2.3.4")) == 0


def test_context_moves_scores_and_decides_added_kinds():
    score = {t: pii.find(t)[0][3] for t in ("write to a@b.co", "a@b.co", "noreply a@b.co")}
    assert score["write to a@b.co"] > score["a@b.co"] > score["noreply a@b.co"]
    assert pii.find("serial DE89 3704 0044 0532 0130 00") == [] and pii.find("x DE89 3704 0044 0532 0130 00") != []


def test_added_spans_do_not_overlap_base_spans():
    text = "call +49 030 1234 5678 or 4111-1111-1111-1111 or me.030@x.de call 030 1234 5678"
    found = pii.find(text)
    base = [x for x in found if x[0] in PATTERNS]
    assert [x[0] for x in found if x[0] == "phone_local"] == ["phone_local"]
    assert not any(a < e and s < b for k, s, e, _ in found if k not in PATTERNS for _, a, b, _ in base)


def test_an_iban_whose_digits_are_a_card_number_too_is_both():
    bban = next(b for b in range(539007547034, 539007547534) if pii.luhn(f"{98 - int(f'{b}111400') % 97:02d}{b}"))
    iban = f"BE{98 - int(f'{bban}111400') % 97:02d}{bban}"
    for text in (f"IBAN {iban} please", f"IBAN {' '.join(iban[i:i + 4] for i in range(0, 16, 4))} please"):
        found = pii.find(text)
        assert [x[0] for x in found] == ["iban", "card"] and found[0][1] == 5
        assert [x[0] for x in found if x[0] == "card"] == [k for k, *_ in brute(text)]
