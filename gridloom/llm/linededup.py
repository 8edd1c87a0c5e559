"""Operator 2, line dedup: drop lines that many documents hold, but for one place.

Lines are normalised to keys and hashed to 128 bits, once; places and hashes are a table. Documents are counted per hash, with partial sums before
the shuffle; a hash over the threshold keeps its lines only in the largest ``doc_id`` that holds it. The places that must go are
gathered per text, and what stays is put together again by position, in time that is in proportion to the number of lines. Full texts move once, in
the last join; the counting moves hashes only, and the one join by hash is a plain equi-join whose hot keys Spark splits at run time.

Defined cases: a null or empty text is one empty line and comes back as the empty text; rows that repeat a
``doc_id`` count as one document, and lose the same lines; a row whose ``doc_id`` is null counts for nothing
and loses every line over the threshold; an empty table gives an empty table; further columns are carried along
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, discard, let, lower_ascii, settled


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _hash(key: Column) -> Column:
    """128 bits, as two longs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key, F.lit(2)).alias("b"))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Settled: (_id, _t1, _t2, pos, a, b), the places and hashes of the lines that are long enough to count, of each text once."""
    hashes = F.transform(F.split(F.col("_text"), "\n", -1), lambda x: let(line_key(x), lambda k: F.when(F.length(k) >= min_chars, _hash(k))))
    each = docs.select("_id", "_t1", "_t2", F.posexplode(hashes).alias("pos", "h")).filter(F.col("h").isNotNull())
    return settled(each.select("_id", "_t1", "_t2", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b")))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Settled: (a, b, keeper) of the lines in at least ``min_docs`` documents.

    As a table of its own it is broadcast if Spark finds it small; else both sides are shuffled by key alone, and hot keys split.
    """
    counts = lines.groupBy("a", "b").agg(F.countDistinct("_id").alias("n"), F.max("_id").alias("keeper"))
    return settled(counts.filter(F.col("n") >= min_docs).drop("n"))


def _judged(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Every row of ``docs`` as ``_row``, its kept text as ``_text``, ``n_lines`` and ``n_dropped``."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"), text.alias("_text"))
    base = base.withColumns({"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit(1), "_text", F.lit(2))})
    lines = long_lines(base.select("_id", "_t1", "_t2", "_text"), min_chars)
    frequent = frequent_lines(lines, min_docs)
    # Null ids are never the keeper: null-safe inequality drops their lines too.
    gone = lines.join(frequent, ["a", "b"]).filter(~F.col("_id").eqNullSafe(F.col("keeper")))
    gone = settled(gone.groupBy("_id", "_t1", "_t2").agg(F.collect_set("pos").alias("_gone")))
    discard(lines, frequent)
    g = gone.withColumnsRenamed({"_id": "_gid", "_t1": "_g1", "_t2": "_g2"})
    joined = base.join(g, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_t1") == F.col("_g1")) & (F.col("_t2") == F.col("_g2")), "left")
    judged = joined.select("_row", F.split("_text", "\n", -1).alias("_lines"), "_gone")
    # Sets of places: by hashing, in proportion to the number of lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("_lines"), i)))
    judged = judged.select("_row", F.size("_lines").cast("long").alias("n_lines"), kept.alias("_kept"))
    return judged.select("_row", F.array_join("_kept", "\n").alias("_text"), "n_lines", (F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs``, all its columns, with ``text`` reduced to its kept lines."""
    judged = _judged(docs, min_chars, min_docs)
    return judged.select(*[F.col("_text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def dedup_lines_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of each document's kept text."""
    judged = _judged(docs.select("doc_id", "text"), min_chars, min_docs)
    return judged.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("_text"), 256).alias("kept_sha256"))
