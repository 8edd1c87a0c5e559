"""Operator 6, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, their beginnings (so that inflected forms share a weight), pairs of neighbours and
pairs with one word between, each hashed to ``2 ** bits`` places; a feature is there or not, however often. Training
sees a bounded sample of the labelled rows: those with the least hash of their id, ``max_rows`` at most, in that
order, ``epochs`` times, in one streaming task whose memory is the weights and one document. Rates are per coordinate
and L1 keeps the weights few, so they are broadcast; their number is bounded by the ``2 ** bits`` places.
Scoring reads every document whole, in Arrow batches, with no shuffle.

Labels, language, source and id never enter a score; the id only decides by ``crc32(id) mod 3`` which rows are held out.

Defined cases: a null or empty text has no features and gets the score of the bias alone; a label is the larger of
several for one id, and a null label none; without a labelled row every score is 0.5; repeated rows score
alike, and of rows with one labelled id that with the least features is learned from; a null id has no label and is not held out; of labels at the
sample's end with one hash the lesser id counts; an empty table gives an empty table; further columns are not read by the report and carried along by the filter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import in_arrow


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    #: Bound of the training sample.
    max_rows: int = 6000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.05
    #: Weight of a toxic row; clean ones weigh 1.
    toxic_weight: float = 3.0
    #: Lengths of the word beginnings that are features beside the word.
    stems: tuple[int, ...] = (4, 5)
    threshold: float = 0.7


_WORD = re.compile(r"[^\W\d_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def featurizer(settings: Settings) -> Callable[[str], np.ndarray]:
    """A function from a text to the places of its features, with repeats."""
    shift = np.uint64(64 - settings.bits)
    known: dict[str, tuple[int, ...]] = {}

    def hashes(word: str) -> tuple[int, ...]:
        if len(known) > 50_000:
            known.clear()
        own = known[word] = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) + (k << 32) for k, p in enumerate([word, *[word[:n] for n in settings.stems]]))
        return own

    def places(text: str) -> np.ndarray:
        found = [known.get(w) or hashes(w) for w in _WORD.findall(text.lower())]
        if not found:
            return np.empty(0, np.int64)
        h = np.array(found, np.uint64)
        w = h[:, 0] * _M1
        pairs = w[:-1] * _M2 + w[1:] + np.uint64(1)
        skips = w[:-2] * _M2 + w[2:] + np.uint64(2)
        every = np.concatenate([h.ravel() * _M1, pairs, skips])
        every ^= every >> np.uint64(29)
        return ((every * _M2) >> shift).astype(np.int64)

    return places


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not 0, and the bias."""
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    sample = rows.select(F.col("doc_id").alias("_id"), "_y", F.xxhash64("doc_id").alias("_order")).orderBy("_order", "_id").limit(settings.max_rows)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    seen = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_order", "_id", "_y", "_text")  # max_rows rows of three numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = featurizer(settings)
        for b in batches:
            data = [np.unique(places(t.as_py())).astype("<u4").tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.int64()), pa.array(data, pa.binary())], ["_order", "_id", "_y", "_x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << settings.bits) + 1  # the last is the bias, which L1 leaves alone
        z, n = np.zeros(size), np.zeros(size)
        l1 = np.full(size, settings.l1)
        l1[-1] = 0
        a, b, l2 = settings.alpha, settings.beta, settings.l2

        def weights(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            return np.where(np.abs(zi) <= l1[i], 0.0, -(zi - np.sign(zi) * l1[i]) / ((b + np.sqrt(n[i])) / a + l2))

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                i = np.append(np.frombuffer(x.as_py(), "<u4").astype(np.int64), size - 1)
                w = weights(i)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y.as_py()
                g *= settings.toxic_weight if y.as_py() else 1.0
                s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / a
                z[i] += g - s * w
                n[i] += g * g
        w = weights(np.arange(size))
        full = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(w[full], pa.float64())], ["place", "weight"])

    featured = in_arrow(seen, features, "_order long, _id long, _y long, _x binary")
    # Of rows that repeat an id, one is learned from: the sample stays within its bound.
    featured = featured.groupBy("_order", "_id", "_y").agg(F.min("_x").alias("_x"))
    turns = featured.withColumn("_epoch", F.explode(F.array(*[F.lit(e) for e in range(settings.epochs)])))
    ordered = turns.repartition(1).sortWithinPartitions("_epoch", "_order", "_id").select("_x", "_y")
    model = in_arrow(ordered, fit, "place long, weight double").toPandas()
    bias = model.loc[model.place == 1 << settings.bits, "weight"].sum()
    model = model[model.place < 1 << settings.bits]
    return model.place.to_numpy(), model.weight.to_numpy(), float(bias)


def _scorer(model: tuple[np.ndarray, np.ndarray, float], settings: Settings) -> Callable[[str | None], float]:
    at, values, bias = model
    weights = np.zeros(1 << settings.bits)
    weights[at] = values
    places = featurizer(settings)

    def of(text: str | None) -> float:
        x = places(text or "")
        x = np.unique(x[weights[x] != 0])
        return float(1 / (1 + np.exp(-np.clip(weights[x].sum() + bias, -35, 35))))

    return of


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model.value, settings)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    scored = in_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without those that score at or above the threshold, all columns kept; nothing is joined."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model.value, settings)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([of(t.as_py()) < settings.threshold for t in texts], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
