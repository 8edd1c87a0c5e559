"""The pipeline's stages one by one, on what they must survive, and the whole run."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gridloom.llm.packing import _new_encoder, encoder
from gridloom.llm.toxicity import score

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
NOUNS = "house river garden window teacher mountain letter winter market sailor bridge forest engine cellar island harbour".split()
FOUL = "vile scum filth rotten stinking".split()
LINE = "This line is shared by many documents, and long enough to count."


def prose(rnd, n, words=NOUNS):
    return " ".join(rnd.choice(words) + str(rnd.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and long texts, copies, repeated rows and ids, shared lines, and foul ones."""
    rnd = random.Random(8)
    rows = [(k, prose(rnd, 60), "en", rnd.choice("abc"), 0) for k in range(160)]
    rows += [(200 + k, " ".join(rnd.choice(FOUL) for _ in range(12)) + " " + prose(rnd, 30), "en", "a", 0) for k in range(80)]
    rows += [(300 + k, prose(rnd, 30) + "\n" + LINE + "\nend " + prose(rnd, 3), "de", "b", 0) for k in range(8)]
    copy = prose(rnd, 80)
    rows += [(400 + k, copy + f" w{k}", "en", "c", 0) for k in range(5)]
    rows += [(500, prose(rnd, 9000), None, None, None), (501, None, "en", "a", 0), (502, "", "en", None, 0), (503, " \n ", None, "a", None)]
    rows += [(None, prose(rnd, 20), None, None, None), (None, None, None, None, None), (504, prose(rnd, 20), "en", "a", 1), (504, prose(rnd, 25), "en", "b", 1)]
    rows += [(505, prose(rnd, 20), "en", "a", 1)] * 3
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, COLUMNS)
    clash = {c: F.col("doc_id").cast("string") for c in ("_row", "_id", "_text", "_dedup", "size", "h1", "_keep", "sid", "label", "_copy", "key", "target")}
    docs.withColumns(clash).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(200 <= k < 300)) for k in range(300)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def bag(df, *names):
    return sorted((tuple(r) for r in df.select(*names or df.columns).collect()), key=repr)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    results = {}
    for name, stage in cp.STAGES:
        after = results[name] = stage(spark, before, folder)
        if name != "packing":
            assert after.columns == columns and dict(after.dtypes) == dict(docs.dtypes), name
            assert set(bag(after, "doc_id", "_row", "_copy", "target")) <= set(bag(before, "doc_id", "_row", "_copy", "target"))
            before = spark.createDataFrame(after.collect(), docs.schema)
        again = stage(spark, docs.limit(0), folder)
        assert again.count() == 0, name
    told = score(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    clean = docs.join(told.filter("predicted = 1").select("doc_id").distinct(), "doc_id", "left_anti")
    assert bag(results["toxicity"], "doc_id", "text") == bag(clean, "doc_id", "text")
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in results["toxicity"].collect()}
    assert len(gone) > 70 and all(200 <= k < 280 for k in gone)
    lines = {r.doc_id: r.text for r in results["line_dedup"].collect()}
    assert [k for k in range(300, 308) if LINE in lines[k]] == [307]
    assert all(r.n_chars == len(r.text) for r in results["line_dedup"].collect())
    near = [r.doc_id for r in results["near_duplicates"].collect()]
    assert [k for k in near if k is not None and 400 <= k < 405] == [400] and near.count(504) == 2 and near.count(505) == 1 and near.count(None) == 2
    mixed = [r.doc_id for r in results["mixing"].collect()]
    assert set(mixed) <= set(near) and max(mixed.count(k) for k in set(mixed)) <= 6  # two rows of id 504 may be taken three times each
    packed = results["packing"].collect()
    starts = sum(r.start == 0 for r in packed)
    assert starts == len(mixed)


def test_the_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    want = sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in cp.STAGES[-1][1](spark, docs, folder).collect() if r.start == 0)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in cp.run(spark, folder).collect() if r.start == 0)
    assert got == want and len(got) > 100
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]


def test_mixing_counts_rows_by_themselves(spark):
    """Of rows that repeat an id or have none, each has its own copies, however they are spread."""
    rnd = random.Random(2)
    rows = [(None, prose(rnd, n), "en", s, 0) for n in (3, 5, 5, 9) for s in ("a", "b", None)] + [(7, prose(rnd, n), "en", "a", 0) for n in (4, 4, 8)] + [(8, "same words here", "en", "b", 0)] * 4
    got = [bag(cp.mixing(spark, spark.createDataFrame(rows, COLUMNS).repartition(n), "")) for n in (1, 3)]
    assert got[0] == got[1] and got[0]
    words = sum(len(r[1].split()) for r in rows)
    assert words - 10 < sum(len(r[1].split()) for r in got[0]) <= words


def test_packing_keeps_few_words(monkeypatch):
    """Packing's workers run beside executors that are full: 400,000 words that differ leave less than 40 MB with one, and ids stay as they are."""
    asked = {}
    monkeypatch.setattr(cp, "pack_documents", lambda docs, tokenizer, **more: asked.update(path=tokenizer, **more))
    cp.packing(None, None, None)
    encode, rnd = _new_encoder(*(asked[k] for k in ("path", "cache_words") if k in asked)), random.Random(6)
    texts = [" ".join(f"{rnd.choice(NOUNS)}{rnd.randrange(10**9)}" for _ in range(4000)) for _ in range(100)]
    tracemalloc.start()
    try:
        for t in texts:
            last = encode(t)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 40e6
    assert last == encoder(asked["path"])(texts[-1]) == encode(texts[-1])
