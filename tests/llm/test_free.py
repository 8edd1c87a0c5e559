"""Operators in free style, against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import near_duplicates
from gridloom.llm import fingerprint as fp
from gridloom.llm import ngram_join as nj
from gridloom.llm import packing as pk
from gridloom.llm import toxicity as tx
from gridloom.llm import warc
from gridloom.llm.graph import components
from gridloom.llm.html_extract import extract, main_text
from gridloom.llm.pii import pii_report

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, _text string, sid long")


NOUNS = "house river garden window teacher mountain letter winter market sailor bridge forest engine cellar island harbour".split()


def prose(rnd, n):
    return " ".join(rnd.choice(NOUNS) + rnd.choice(["", "s", "ly", ",", "."]) for _ in range(n))


# fingerprints


def test_fingerprints(spark):
    rnd = random.Random(1)
    texts = [None, "", "One. Two.\nThree.", "One. Two.\nThree.", "é𝄞 x" * 50, prose(rnd, 4000), *["a! " * 400, "b! " * 300], *[prose(rnd, rnd.randrange(200)) for _ in range(20)]]
    ids = list(range(0, 5 * len(texts), 5))
    df = docs(spark, texts, ids)
    got = {r.doc_id: r for r in fp.fingerprint_report(df.repartition(3), slice_rows=4).collect()}
    assert sorted(got) == ids
    for k, t in enumerate(texts):
        t, after, r = t or "", texts[(k + 1) % len(texts)] or "", got[ids[k]]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = set(fp.digests(t).tolist()), set(fp.digests(other).tolist())
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[10].fingerprint == got[15].fingerprint and got[10].near_next == 1.0 and got[0].near_next == 1.0
    assert fp.fingerprint_report(docs(spark, [])).count() == 0
    assert fp.fingerprint_report(docs(spark, ["alone here."])).first().near_next == 1.0
    lost = docs(spark, ["p. q.", "r.", "s.", "r."], [None, 1, 1, 1])
    assert fp.fingerprint_report(lost).count() == 4


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 60, dtype=np.uint64)
    s = fp.Sketches(np.array([96]))
    s.add(keys[:40], np.zeros(40, int))
    s.add(keys[20:], np.zeros(40, int), -1)
    found, _, sign, clean = s.peel()
    assert clean[0] and set(found[sign > 0].tolist()) == set(keys[:20].tolist()) and set(found[sign < 0].tolist()) == set(keys[40:].tolist())
    small = fp.Sketches(np.array([24]))
    small.add(keys, np.zeros(60, int))
    assert not small.peel()[3][0]
    assert fp.difference([keys[:50], keys[:0]], [keys[30:], keys[:0]])[0].tolist() == [30, 0]
    twice = np.concatenate([keys[:5], keys[:1]])
    assert fp.difference([twice], [keys[5:9]])[1].tolist() == [4]


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
<header><h1>Site, name</h1></header><div class="ad">Buy this, now, or never, it is the best, cheapest, largest thing.</div><div id=main><article><header><h1>A &amp; B</h1></header>
<p>First <b>bold</b>part,
 of it &lt;x&gt;.<br>More.<p>Second, with a <a href="u">link</a>.<ul><li>one<li>two</ul><aside>Aside, aside.</aside><form>Form <input> text</form></article>
<div class="comments"><p>I, for one, disagree, entirely, with all of it, and so should you, dear reader.</p></div></div><aside class=sidebar><p>Side, bar.</p></aside><footer>&copy; foot</footer>"""


def test_html(spark):
    assert main_text(PAGE) == "A & B First boldpart, of it <x>. More. Second, with a link. one two"
    rows = [(1, "u", PAGE, "e"), (2, None, None, "e"), (3, "u", "", "e"), (4, "u", "plain text, only", "e"), (5, "u", "<p>a<p>b</div></p>< c <!-- never closed", "e"), (6, "u", "<div>" * 3000 + "deep" + "<a b='>", "e")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[2].text == "" and got[3].n_chars == 0 and got[4].text == "plain text, only" and got[5].text.startswith("a b") and "deep" in got[6].text
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("n", [2, 40])
def test_html_of_any_length_keeps_the_article(n):
    body = [f"Paragraph {k}, which is long enough, with commas, to count as prose in every respect that matters here." for k in range(n)]
    inner = "<h1>Head</h1><div>" + "".join(f"<p>{x}</p>" for x in body) + "</div><section><p>Short end.</p></section>"
    comments = "<div class=comments>" + "<p>I, for one, disagree, entirely, with all of it, and so should you, dear reader.</p>" * 99 + "</div>"
    want = " ".join(["Head", *body, "Short end."])
    assert main_text(f"<body><article>{inner}</article></body>") == want
    assert main_text(f"<body><div class='post no-sidebar'><article>{inner}</article></div><div class=sidebar><p>Side, bar.</p></div></body>") == want
    assert main_text(f"<body><article>{inner}</article>{comments}</body>") == want  # most of the text, and still no article


def test_html_without_an_article():
    body = "".join(f"<p>Paragraph {k}, which is long enough, with commas, to count as prose in every respect that matters here.</p>" for k in range(4))
    links = "<div>" + "".join(f'<a href="/{k}">Some link text, number {k}</a> ' for k in range(30)) + "</div>"
    text = main_text(f"<html><body>{links}<div class=content><h2>Head</h2>{body}</div>{links}</body></html>")
    assert text.startswith("Head Paragraph 0") and "link text" not in text


# toxicity


def naive_difference(sizes, k):
    """Differencing with every partial partition as a full list of k sums."""
    left = [(n if k > 1 else 0, -i, sorted([n] + [0] * (k - 1), reverse=True)) for i, n in enumerate(sizes)]
    serial = len(sizes)
    while len(left) > 1:
        left.sort(key=lambda x: x[:2], reverse=True)
        a, b = left[0][2], left[1][2]
        merged = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        left = [*left[2:], (merged[0] - merged[-1], -serial, merged)]
        serial += 1
    return left[0][2] if left else [0] * k


def test_packing_against_naive_differencing():
    rnd = random.Random(11)
    for _ in range(300):
        sizes = [rnd.randrange(1, 100) for _ in range(rnd.randrange(1, 14))]
        k = rnd.randrange(1, 7)
        parts = pk.difference(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) == k
        assert sorted((sum(sizes[i] for i in p) for p in parts), reverse=True) == naive_difference(sizes, k)
        # The count rises until differencing fits; pieces stay whole.
        capacity, count = 100, -(-sum(sizes) // 100)
        while max(naive_difference(sizes, count)) > capacity:
            count += 1
        whole = pk.pack([(i, 0, n) for i, n in enumerate(sizes)], capacity, cut=False)
        assert len(whole) == count and sorted(p for w in whole for p in w) == [(i, 0, n) for i, n in enumerate(sizes)]


def test_toxicity(spark):
    rnd = random.Random(7)
    texts, toxic = [], []
    for _ in range(900):
        bad = rnd.random() < 0.3
        t = prose(rnd, rnd.randrange(5, 60)).split()
        for _ in range(rnd.randrange(2, 4) if bad else 0):
            t.insert(rnd.randrange(len(t)), "gruk" + rnd.choice(["", "a", "on", "ite", "xyz" + str(rnd.random())[2:5]]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.score(docs(spark, [*texts, None, ""]), labels).collect()}
    assert len(got) == 902
    held = [k for k in range(900) if got[k].held_out]
    assert held == [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    right = sum(got[k].predicted == toxic[k] for k in held) / len(held)
    assert right > 0.97 and got[900].score == got[901].score < 0.5
    # Labels of held-out rows play no part.
    flipped = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in tx.score(docs(spark, texts), flipped).collect()}
    assert all(again[k] == got[k].score for k in range(900))
    kept = tx.drop_toxic(docs(spark, [*texts, None]), labels)
    assert {r.doc_id for r in kept.collect()} == {k for k in got if k < 900 and not got[k].predicted} | {900} and kept.columns == docs(spark, []).columns
    none = labels.filter("toxic is null")
    assert {r.score for r in tx.score(docs(spark, texts[:5]), none).collect()} == {0.5}
    assert tx.score(docs(spark, []), labels).count() == 0


# packing


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    encode = pk.encoder(VOCABULARY)
    rnd = random.Random(2)
    cases = ["", " ", "a   b", "\n\n x  y", "a \n b", "don't we've it's.  'll", "<|endoftext|> x", "x.\ny_ z__ a²! ½. é ", "c 　d", "\t a\t\tb", "rock'n'roll' 5's.", " \x1c a \x85 b"]
    cases += ["".join(rnd.choice("ab é.,'\n\t 1_!") for _ in range(60)) for _ in range(300)]
    for text in cases:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark):
    rnd = random.Random(4)
    texts = [None, "", *[prose(rnd, rnd.choice([3, 50, 700, 4000])) for _ in range(60)], "a b"]
    rows = pk.pack_documents(docs(spark, texts).coalesce(2), VOCABULARY, group_windows=4).collect()
    encode = pk.encoder(VOCABULARY)
    ids = {k: np.append(np.frombuffer(encode(t or ""), "<u4"), 1).astype("<u4") for k, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, total in [(sorted(p), len(ids[k])) for k, p in by_doc.items()] + [(sorted(p), None) for p in by_sequence.values()]:
        at = 0
        for start, n in pieces:
            assert start == at and n > 0
            at += n
        assert at == total if total is not None else at <= 2048 and (at & (at - 1)) == 0
    assert set(by_doc) == set(ids)
    assert pk.pack_documents(docs(spark, []), VOCABULARY).count() == 0


def test_differencing():
    sizes = [8, 7, 6, 5, 4]
    parts = pk.difference(sizes, 2)
    assert sorted(sum(sizes[i] for i in p) for p in parts) == [14, 16]  # what the differencing method gives here
    assert pk.difference([], 3) == [[], [], []] and pk.difference([5], 1) == [[0]]
    rnd = random.Random(0)
    sizes = [rnd.randrange(1, 400) for _ in range(400)]
    sums = [sum(sizes[i] for i in p) for p in pk.difference(sizes, 8)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 2
    pieces = [(k, 0, rnd.randrange(200, 1000)) for k in range(100)]
    whole = pk.pack(pieces, 1000, cut=False)
    assert all(sum(p[2] for p in w) <= 1000 for w in whole) and sorted(p for w in whole for p in w) == pieces
    assert len(whole) > len(pk.pack(pieces, 1000, cut=True))  # the window count rises without cuts


# WARC


def test_warc(spark):
    rows = [(k, f"http://x/{k}", h, "e") for k, h in enumerate(["<p>a</p>", "<p>b é</p>", "<p>a</p>", "", None, "<p>a</p>", "c" * 100_000])] + [(None, None, "<p>a</p>", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    got = {r.page_id: tuple(r)[1:] for r in warc.warc_report(pages).collect()}
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    first = {}
    for k, _, h, _ in rows[:-1]:
        first.setdefault(h or "", k)
    for k, _, h, _ in rows:
        lead = first[h or ""]
        assert got[k] == (len((h or "").encode()), digest(h or ""), "response" if lead == k else "revisit", None if lead == k else lead)
    large = {r.page_id: r.record_type for r in warc.warc_report(pages, min_bytes=9).collect()}
    assert large[2] == "response"
    assert warc.warc_report(pages.filter("page_id > 99")).count() == 0


def test_salvage(spark):
    records = [warc.encode(k, "u", f"page {k} ".encode() * 50, warc.digest(f"page {k} ".encode() * 50), k, False, "2024-01-01T00:00:00Z") for k in range(6)]
    ids = lambda a: [int(r.headers["x-page-id"]) for r in a.records]
    whole = b"".join(records)
    assert ids(warc.salvage(whole)) == list(range(6)) and not warc.salvage(whole).gaps
    start = len(records[0]) + len(records[1])
    hurt = bytearray(whole)
    hurt[start + 30 : start + 40] = b"\0" * 10
    out = warc.salvage(bytes(hurt))
    assert ids(out) == [0, 1, 3, 4, 5] and [g[:2] for g in out.gaps] == [(start, start + len(records[2]))]
    cut = warc.salvage(whole[:-7])
    assert ids(cut) == list(range(5)) and cut.gaps[0][0] == len(whole) - len(records[5])
    mixed = warc.salvage(b"junk" + zlib.decompress(records[3], 31) + b"junk" + records[4])
    assert ids(mixed) == [3, 4] and len(mixed.gaps) == 2
    bad = zlib.decompress(records[3], 31).replace(b"page 3 page 3", b"page 3 page 9", 1)
    assert ids(warc.salvage(bad + records[4])) == [4] and warc.salvage(b"").records == []


def test_salvage_within_members_of_several_records():
    rnd = random.Random(4)
    plain = []
    for k in range(8):
        body = rnd.randbytes(20_000)
        plain.append(zlib.decompress(warc.encode(k, "u", body, warc.digest(body), k, False, "2024-01-01T00:00:00Z"), 31))

    def member(parts):
        packer = zlib.compressobj(wbits=31)
        return packer.compress(b"".join(parts)) + packer.flush()

    ids = lambda a: [int(r.headers["x-page-id"]) for r in a.records]
    whole = member(plain)
    assert ids(warc.salvage(whole)) == list(range(8)) and not warc.salvage(whole).gaps
    bad = plain[3][:-100] + b"?" * 96 + plain[3][-4:]
    some = member([*plain[:3], bad, *plain[4:6]])
    out = warc.salvage(some + member(plain[6:]))
    start = sum(map(len, plain[:3]))
    assert ids(out) == [0, 1, 2, 4, 5, 6, 7]
    assert [g[:2] for g in out.gaps] == [(0, len(some))] and f"bytes {start} to {start + len(bad)} of the member" in out.gaps[0][2]
    cut = whole[: len(whole) * 5 // 8 - 2000]
    assert ids(warc.salvage(cut)) == [0, 1, 2, 3] and warc.salvage(cut).gaps[0][:2] == (0, len(cut))
    out = warc.salvage(cut + member(plain[6:]))  # the damage is in the middle of the archive
    assert ids(out)[:4] == [0, 1, 2, 3] and ids(out)[-2:] == [6, 7] and out.gaps[0][:2] == (0, len(cut))


def test_damaged_archives_are_read_around(spark):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 40) for k in range(8)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages)
    path = manifest.first().path
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        data = f.read()
    with fs.open_output_stream(at, compression=None) as f:
        f.write(data[: len(data) // 2] + b"\xff" * 9 + data[len(data) // 2 + 9 :])
    rows = warc.read_archives(manifest).collect()
    assert 6 <= sum(r.page_id is not None for r in rows) < 8 and any(r.gap_start is not None for r in rows)


# n-gram join


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return [(k, len(s), find(k)) for k, s in enumerate(sets)]


def corpus(rnd):
    texts = [None, "", " \n", "one", "One", "one two", "two one"]
    for _ in range(6):
        seed = prose(rnd, rnd.choice([4, 12, 60, 200])).split()
        for _ in range(rnd.randrange(1, 9)):
            t = list(seed)
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(len(t))] = rnd.choice(NOUNS) + "x"
            texts.append(" ".join(t))
            seed = t if rnd.random() < 0.5 else seed  # chains of small changes
    return texts


@pytest.mark.parametrize(("seed", "settings"), [(0, nj.Settings()), (1, nj.Settings(shared=2, direct=1, rounds=3, broadcast_ids=0, bloom_bits=10, counter_bits=8)), (2, nj.Settings(direct=2, rounds=1))])
def test_ngram_join(spark, seed, settings):
    texts = corpus(random.Random(seed))
    got = sorted(tuple(r) for r in nj.linked(docs(spark, texts), settings).collect())
    assert got == brute_components(texts)


def cloud(rnd, n, words, most):
    """``n`` near copies of one text, each with a few words of its own; every fifth is a near copy of an earlier one."""
    base = [f"w{rnd.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(n):
        t = list(rnd.choice(out)) if out and k % 5 == 0 else list(base)
        for _ in range(1 if out and k % 5 == 0 else rnd.randrange(most)):
            t[rnd.randrange(words)] = rnd.choice(["x", f"y{rnd.randrange(50)}", f"z{rnd.randrange(10**6)}"])
        out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize(("n", "words", "most"), [(1000, 100, 8), (300, 40, 6)])
def test_near_copies_in_large_groups(spark, monkeypatch, n, words, most):
    """Exact, with pairs far below the square of the group."""
    texts = cloud(random.Random(n), n, words, most)
    formed, verify, close = [], nj._verify, nj._close
    monkeypatch.setattr(nj, "_verify", lambda d, i, pairs, s: formed.append(pairs.count()) or verify(d, i, pairs, s))
    monkeypatch.setattr(nj, "_close", lambda pairs, d, s: formed.append(pairs.count()) or close(pairs, d, s))
    got = sorted(tuple(r) for r in nj.linked(docs(spark, texts)).collect())
    assert got == brute_components(texts)
    assert 30 < len({c for _, _, c in got}) < n
    assert sum(formed) < n * n / 10, formed


def element_joins(spark, run):
    """Rows made by each join of a bucket's elements with one row a key, as Spark's plans report them."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    run()
    bus.waitUntilEmpty()
    out, runs = [], store.executionsList()
    for at in {runs.apply(k).executionId() for k in range(runs.size())} - before:
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[b#\d+L?, t#\d+L?\], \[b#\d+L?, t#\d+L?\], Inner(, Build\w+)?(, false)?$", node.desc()):
                of = {node.metrics().apply(k).name(): node.metrics().apply(k).accumulatorId() for k in range(node.metrics().size())}
                out.append(int(values.apply(of["number of output rows"]).replace(",", "")))
    return out


def test_elements_of_buckets_are_joined_once(spark, monkeypatch):
    """A round joins elements with their counts and with what meets there, once each; the rows grow as the group does, not as its square."""
    meet, rounds, made = nj._meet, [], []
    monkeypatch.setattr(nj, "_meet", lambda deltas, s: rounds.append(1) or meet(deltas, s))
    for n in (400, 800):
        texts = cloud(random.Random(n), n, 40, 6)
        rounds.clear()
        rows = element_joins(spark, lambda texts=texts: nj.linked(docs(spark, texts)).collect())
        assert rounds and len(rows) == 2 * len(rounds)
        made.append(sum(rows))
    assert 0 < made[1] < 3 * made[0]


def test_two_large_groups_under_common_shingles(spark, monkeypatch):
    """Near copies of two texts that share most shingles but never link: links found are used at once, so that few meet again."""
    rnd, n, words = random.Random(1), 200, 150
    base = [f"w{k}" for k in range(words)]
    texts = []
    for text in (base, ["v" if k >= 10 and k % 25 == 10 else w for k, w in enumerate(base)]):
        for _ in range(n):
            t = list(text)
            for _ in range(rnd.randrange(1, 5)):
                t[rnd.randrange(words)] = f"y{rnd.randrange(2 * n)}"
            texts.append(" ".join(t))
    meet, rounds, got = nj._meet, [], []
    monkeypatch.setattr(nj, "_meet", lambda deltas, s: rounds.append(deltas.count()) or meet(deltas, s))
    made = element_joins(spark, lambda: got.extend(nj.linked(docs(spark, texts)).collect()))
    assert sorted(map(tuple, got)) == brute_components(texts)
    assert len(rounds) < nj.Settings().rounds and sum(made) < 60 * len(texts), (rounds, made)


def test_sets_with_one_name(spark, monkeypatch):
    """Sets that share their first 64 bits stay apart."""
    own = nj._name
    monkeypatch.setattr(nj, "_name", lambda x: (len(x) % 2).to_bytes(8, "little") + own(x)[8:])
    rows = nj.prefixes(docs(spark, ["a b c d", "e f g h", "e f g h", "a b c"]), nj.Settings()).collect()
    assert len({r.sid for r in rows}) == 3 and len({r.s1 for r in rows}) == 2


def test_ngram_join_small_cases(spark):
    assert nj.linked(docs(spark, [])).count() == 0
    text = prose(random.Random(1), 30)
    lost = docs(spark, [text, text, text, "other words here"], [None, 4, 9, 9])
    assert sorted(map(tuple, nj.linked(lost).select("doc_id", "component_id").collect()), key=str) == [(4, 4), (9, 4), (9, 9), (None, None)]
    kept = nj.keep_one(lost)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "9", "None"] and kept.columns == lost.columns


def components_by_sets(texts, words, num, den):
    """The least row of each row's component, from every pair of shingle sets."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if den * both >= num * (len(a) + len(sets[j]) - both):
                u, v = sorted((least[i], least[j]))
                least = [u if x == v else x for x in least]
    return least


def test_near_duplicates_stage(spark):
    rnd = random.Random(5)
    texts = []
    for changes in (1, 2, 3, 4, 4, 5, 6, 8):
        seed = [f"w{rnd.randrange(9999)}" for _ in range(200)]
        t = list(seed)
        for k in range(changes):
            t[10 + k * (180 // changes)] = f"new{k}"
        texts += [" ".join(seed), " ".join(t)]
    short = [f"s{rnd.randrange(9999)}" for _ in range(9)]  # sets of 5 and 4 shingles, just at the threshold
    texts += [" ".join(short), " ".join(short[:-1]), "a b c", "a b c", "a b d"]
    at_stage, at_query = components_by_sets(texts, 5, 80, 100), components_by_sets(texts, 3, 90, 100)
    assert len(set(at_stage)) < len(set(at_query))  # some pairs lie between the two thresholds
    kept = sorted(r.doc_id for r in near_duplicates(spark, docs(spark, texts), "").collect())
    assert kept == sorted(set(at_stage))


def test_repeated_ids_lose_no_text(spark):
    rnd = random.Random(3)
    a, b, c, d = (prose(rnd, 40) for _ in range(4))
    rows = [(4, a), (9, a), (9, b), (9, b), (7, c), (7, d), (1, ""), (1, ""), (1, None), (2, ""), (None, a), (None, a)]
    want = sorted([(4, a), (9, b), (7, c), (7, d), (1, ""), (1, None), (2, ""), (None, a), (None, a)], key=str)
    for n in (1, 5):  # however the rows are spread
        lost = docs(spark, [t for _, t in rows], [k for k, _ in rows]).repartition(n)
        assert sorted(((r.doc_id, r.text) for r in nj.keep_one(lost).collect()), key=str) == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# rows that are there twice


def test_repeated_rows(spark):
    text = "Mail a@b.example now. " + prose(random.Random(6), 50)
    twice = docs(spark, [text, text, "other"], [1, 1, 2])
    rows = [r for r in pk.pack_documents(twice, VOCABULARY).collect() if r.start == 0]
    assert sorted(r.doc_id for r in rows) == [1, 1, 2] and len({r.doc_tokens for r in rows if r.doc_id == 1}) == 1
    assert [r.spans for r in pii_report(twice).collect() if r.doc_id == 1] == ["email:5:16"] * 2
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    scored = tx.score(twice.unionByName(docs(spark, ["x"], [None])), labels).collect()
    assert len(scored) == 4 and len({r.score for r in scored if r.doc_id == 1}) == 1 and not next(r for r in scored if r.doc_id is None).held_out
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "v", PAGE), (2, "w", PAGE), (2, "w", PAGE), (3, "x", None), (3, "x", None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url, r.n_chars > 0) for r in extract(pages).collect()) == [(1, "u", True), (1, "v", True), (2, "w", True), (2, "w", True), (3, "x", False), (3, "x", False)]
    told = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.warc_report(pages).collect())
    assert told == [(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2 + [(3, "response", None)] * 2


def test_training_against_plain_ftrl(spark):
    """Weights one by one, feature by feature, in the order of the sample."""
    rnd = random.Random(9)
    s = tx.Settings(bits=9, max_rows=25, epochs=3, l1=0.3, l2=0.1, alpha=0.5, beta=1.5, toxic_weight=2.0)
    texts = [prose(rnd, rnd.randrange(1, 12)) for _ in range(60)]
    toxic = {k: rnd.randrange(2) for k in range(60)}
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    order = labels.filter(~tx.held_out(F.col("doc_id"))).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(s.max_rows).collect()
    assert len(order) == s.max_rows and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in order)
    z, n, places = {}, {}, tx.featurizer(s)

    def weight(i):
        l1 = 0.0 if i == "bias" else s.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for r in order:
            features = [*sorted(set(places(texts[r.doc_id]).tolist())), "bias"]
            w = {i: weight(i) for i in features}
            y = toxic[r.doc_id]
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (s.toxic_weight if y else 1.0)
            for i in features:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    at, values, bias = tx.train(docs(spark, texts), labels, s)
    got = dict(zip(at.tolist(), values.tolist(), strict=True))
    assert 0 < len(got) < 2**9 and got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-12) for i in want) and bias == pytest.approx(weight("bias"), rel=1e-9)
