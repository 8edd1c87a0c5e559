"""Operators made of built-in functions, against plain Python."""

import hashlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridloom.llm.common import running
from gridloom.llm.linededup import dedup_lines, dedup_lines_report
from gridloom.llm.mixing import mix, mix_report
from gridloom.llm.pii import findings, mod97, pii_report, redact
from gridloom.llm.quality import clean_lines, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, key string"


def docs(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or ["a"] * len(texts))[k], 0, "mine", "too") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    places = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places), n < 50 or 100 * len(places) > 50 * n)


_NOUNS = "house river garden window teacher mountain letter winter market sailor bridge forest engine cellar island harbour".split()
GOOD = "\n".join(f"Near the {_NOUNS[i]} we saw a {_NOUNS[(5 * i + 3) % 16]}, and the {_NOUNS[(7 * i + 1) % 16]} of our {_NOUNS[(3 * i + 2) % 16]} was {i} years older." for i in range(6))


def test_quality(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", "a b c a b c a b c", "x\nx\n\nx é y", GOOD, "\n".join("Home | About | News | Contact | Login | Help" for _ in range(20)), GOOD.upper().replace(" ", "!! ")]
    texts += [" ".join(rnd.choice("a b c d e f # | é".split()) for _ in range(rnd.randrange(120))) for _ in range(15)]
    texts.append("word " * 5000)
    got = {r.doc_id: r for r in quality(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), (k, t)
        assert not (r.base_failed and r.kept)
    assert got[5].kept and not got[6].kept and not got[7].kept
    kept = clean_lines(docs(spark, [GOOD + "\nAll rights reserved. Click here.\n\nYes."])).first()
    assert kept.text == GOOD + "\n\nYes." and kept._text == "mine"
    assert quality(docs(spark, [])).count() == 0


def brute_dedup(texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for k, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(k)
    out = []
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == k]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    often = "This line is at least FORTY characters long, ÄÖ Σ and so on"
    texts = [None, "", *[f"\t{often} \nown {k}\n{often.replace('FORTY', 'forty')}" for k in range(6)], often.replace("Ä", "ä"), *[("É" * 40) + f"\n{k}" for k in range(4)], "x" * 40, often + "x"]
    out = sorted(tuple(r) for r in dedup_lines_report(docs(spark, texts)).collect())
    assert out == brute_dedup(texts)
    full = dedup_lines(docs(spark, texts))
    assert full.columns == docs(spark, []).columns
    clash = docs(spark, texts).withColumns({c: F.col("doc_id") * 2 for c in ("_dedup", "_gone", "_t1", "_row", "n_lines", "pos")})
    assert dedup_lines(clash).columns == clash.columns and {(r._dedup, r.n_lines, r.text) for r in dedup_lines(clash).collect()} == {(2 * r.doc_id, 2 * r.doc_id, r.text) for r in full.collect()}
    assert {r.doc_id: r.text for r in full.collect()}[2] == "own 0"
    assert dedup_lines_report(docs(spark, [])).count() == 0
    twice = docs(spark, texts)
    assert dedup_lines_report(twice.unionByName(twice)).count() == 2 * len(texts)
    lost = twice.withColumn("doc_id", F.when(F.col("doc_id") == 7, None).otherwise(F.col("doc_id")))
    assert {r.doc_id: r.n_dropped for r in dedup_lines_report(lost).collect()}[None] == 2


def test_line_dedup_of_rows_with_one_id(spark):
    """Each row loses the lines at its own places."""
    often = ["This line is at least forty characters long, number " + str(k) for k in range(2)]
    rows = [(k, often[0]) for k in range(5)] + [(0, "own\n" + often[0]), (0, often[1] + "\n" + often[0]), (0, often[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in dedup_lines(df).collect())
    assert kept == [(0, ""), (0, ""), (0, often[1]), (0, "own"), (1, ""), (2, ""), (3, ""), (4, often[0])]


def test_many_lines_of_one_text(spark):
    """50,000 shared lines in each of six texts: in proportion to the lines."""
    text = "\n".join(f"A line that is long enough to be counted, number {k}" for k in range(50_000))
    began = time.perf_counter()
    out = {r.doc_id: (r.n_lines, r.n_dropped) for r in dedup_lines_report(docs(spark, [text] * 6)).collect()}
    assert out == {**dict.fromkeys(range(5), (50_000, 50_000)), 5: (50_000, 0)} and time.perf_counter() - began < 60


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute_pii(t):
    n = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m.span()) for m in EMAIL.finditer(t)]
    found += [("ip", m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m.span()) for m in CARD.finditer(t) if 13 <= len(n(m)) <= 19 and luhn(n(m))]
    found += [("phone", m.span()) for m in PHONE.finditer(t) if 9 <= len(n(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, (a, b) in found)


def test_pii(spark):
    rnd = random.Random(5)
    texts = [
        None, "", "mail é𝄞 a.b+c@x-y.example.com, d@e.f-g_h@i.j", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 79927398713",
        "+1 (743) 555-3824 and +49 30 1234567- +1+22 333 444 55", "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "my ssn is 123-45-6789; order 123-45-6789 of goods bought in the shop by the lake and far away",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "call (743) 555-3824 now", "9" * 3000 + "." + "a" * 5000 + "@",
    ]
    texts += ["".join(rnd.choice("01259.. -+()@ab_%é") for _ in range(rnd.randrange(200))) for _ in range(60)]
    got = {r.doc_id: r for r in pii_report(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = brute_pii(t or "")
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[k])
        assert got[k].spans.startswith(want) and got[k].n_email + got[k].n_ip + got[k].n_card + got[k].n_phone == len([x for x in want.split(",") if x])
    shown = lambda k, kind: [texts[k][int(a) : int(b)] for x in got[k].spans.split(",") for i, a, b in [x.split(":")] if i == kind]
    assert shown(6, "iban") == ["GB82 WEST 1234 5698 7654 32"]
    assert shown(7, "ssn") == ["123-45-6789"]
    assert shown(8, "secret") == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert shown(9, "local_phone") == ["(743) 555-3824"]
    assert "local_phone" not in got[5].spans
    out = {r.doc_id: r.text for r in redact(docs(spark, texts)).collect()}
    assert out[9] == "call <local_phone> now" and out[8] == 'token = "<secret>" x' and out[1] == ""
    assert findings(docs(spark, [])).count() == 0
    assert spark.createDataFrame([("DE89 3704 0044 0532 0130 00",)], "x string").select(mod97(F.col("x")).alias("ok")).first().ok


def test_pii_of_long_texts(spark):
    """1 MB of numbers: in proportion to the text, and still exact."""
    texts = ["1," * 500_000, "1.2.3.4 " * 60_000, "+49 30 1234567; " * 40_000, "4111 1111 1111 1111, a@b.c " * 20_000, "call (743) 555-3824 " * 30_000, "1 " * 300_000]
    began = time.perf_counter()
    for r in pii_report(docs(spark, texts)).collect():
        assert r.base_sha256 == hashlib.sha256(brute_pii(texts[r.doc_id]).encode()).hexdigest()
    hidden = {r.doc_id: r.text for r in redact(docs(spark, texts)).collect()}
    assert hidden == {0: texts[0], 1: "<ip> " * 60_000, 2: "<phone>; " * 40_000, 3: "<card>, <email> " * 20_000, 4: "call <local_phone> " * 30_000, 5: texts[5]}
    assert time.perf_counter() - began < 120


def test_redaction_of_spans_that_overlap(spark):
    text = "x" * 5000 + " a1.2.3.4@b.c é𝄞 " + "y" * 9000 + " 1.2.3.4"
    assert redact(docs(spark, [text, None, text[:5001]])).collect()[0].text == "x" * 5000 + " <email> é𝄞 " + "y" * 9000 + " <ip>"


def test_running(spark):
    rnd = random.Random(0)
    lists = [[], [3], *[[rnd.randrange(-50, 50) for _ in range(n)] for n in (2, 3, 4, 5, 17, 100, 101)]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<int>")
    got = {r.k: (r.s, r.m) for r in df.select("k", running(F.col("x"), lambda a, b: a + b, F.lit(0)).alias("s"), running(F.col("x"), F.greatest, F.lit(-99)).alias("m")).collect()}
    for k, x in enumerate(lists):
        assert got[k] == (list(itertools.accumulate(x)), list(itertools.accumulate(x, max)))


def test_pii_without_digits_and_with_words_after(spark):
    at, es = "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332"
    texts = ["password = correcthorsebatterystaple", "Api_Key: " + "abcdefgh" * 2 + " end"]
    texts += [f"to {n}{tail}" for n in (at, es) for tail in ("", " EUR", " BIC", " BANK", " COBADEFF", " BIC COBADEFFXXX", " EUR 12", " and more", ".")]
    texts += ["to AT61 1904 3002 3457 3202 EUR", "to GB82 EUR BANK"]
    got = {r.doc_id: r.spans for r in pii_report(docs(spark, texts)).collect()}
    shown = [[texts[k][int(a) : int(b)] for x in got[k].split(",") if x for i, a, b in [x.split(":")] if i in ("iban", "secret")] for k in range(len(texts))]
    assert shown == [["correcthorsebatterystaple"], ["abcdefghabcdefgh"], *[[at]] * 9, *[[es]] * 9, [], []]
    assert redact(docs(spark, texts[3:4])).first().text == "to <iban> EUR"


def brute_mix(texts, sources):
    size = [len(WORDS.findall(t or "")) for t in texts]
    names = sorted({s for s in sources if s is not None}) + ([None] if None in sources else [])
    total = {s: sum(n for n, x in zip(size, sources, strict=True) if x == s) for s in names}
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest, share = sum(total.values()) - sum(3 * total[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if share and 3 * total[s] * share < rest * weight[s]}
        if more <= capped:
            break
        capped |= more
    target = {s: float(3 * total[s]) if s in capped else float(rest) * weight[s] / max(share, 1) for s in names}
    queue = []
    for s in names:
        at = 0
        for k, n in sorted(((k, size[k]) for k in range(len(texts)) if sources[k] == s), key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0])):
            at += n
            queue += [((e * total[s] + at) / target[s] if target[s] else 0.0, names.index(s), hashlib.md5(str(k).encode()).hexdigest(), k, e, n) for e in range(3)]
    taken, run = dict.fromkeys(range(len(texts)), 0), 0
    for *_, k, _, n in sorted(queue):
        run += n
        if run > sum(size):
            break
        taken[k] += n
    return [(k, size[k], total[sources[k]], target[sources[k]], taken[k]) for k in range(len(texts))]


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rnd = random.Random(seed)
    texts = [rnd.choice([None, "", *["w " * rnd.randrange(1, 60)] * 8]) for _ in range(90)]
    sources = [rnd.choice(["b", "a", "é", None, *["hot"] * (4 * seed)]) for _ in texts]
    got = sorted(tuple(r) for r in mix_report(docs(spark, texts, sources)).collect())
    want = brute_mix(texts, sources)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    rows = [r for r in mix(docs(spark, texts, sources)).collect()]
    counted = {}
    for r in rows:
        counted[r.doc_id] = counted.get(r.doc_id, 0) + len(WORDS.findall(r.text or ""))
    assert {k: n for k, n in counted.items() if n} == {w[0]: w[4] for w in want if w[4]}
    assert all(isinstance(r, Row) and r.key == "too" for r in rows)


def test_mixing_small_cases(spark):
    assert mix_report(docs(spark, [])).count() == 0
    assert mix_report(docs(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
    one = docs(spark, ["a b c"])
    assert mix_report(one).first().taken == 3
    assert mix(one.unionByName(one)).count() == 2
