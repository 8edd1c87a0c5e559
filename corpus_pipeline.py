"""A training corpus from ``documents``: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``, and carry further ones along.

Defined cases, in every stage: a null or empty text is a text without words, which is clean, has one empty line, is like no other, has size 0 and
so is never mixed in; a null id is a row of its own, never dropped as a copy; a null source is a source; rows that repeat an id are judged each by its own text;
an empty table gives an empty table; columns with any other name are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import discard, settled, table
from gridloom.llm.linededup import dedup_lines
from gridloom.llm.mixing import mix
from gridloom.llm.ngram_join import Settings, keep_one
from gridloom.llm.packing import pack_documents
from gridloom.llm.registry import tokenizer_path
from gridloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles at 0.8, not what operator 9's query asks for."""
    return keep_one(docs, Settings(words=5, num=80, den=100))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


#: Packing runs on executors whose heap the stages before it have filled, and its workers live on: they keep a tenth of the words that operator 7 keeps alone.
PACKING_WORDS = 100_000


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in the sequences."""
    return pack_documents(docs, tokenizer_path(), cache_words=PACKING_WORDS)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Trained scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is Parquet in the shared folder, and goes when the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
