"""Operator 1, quality rules: judge lines first, then reject documents that lose too much text.

Every line of a document is held against rules of three kinds: punctuation (a line ends like a sentence, is not
shouted and not made of symbols), navigation (menus: cells between separators) and boilerplate (legal and site
notices, text repeated within the line). Lines that fail are removed. A document is rejected when the kept lines
hold less than a given part of its text, or when it fails the base rules on its words.

All of it is computed within one row by built-in functions: no shuffle, no Python, memory bounded by one text.

Defined cases: a null or empty text has no words and fails the base rules; a document without a line that has a word
is rejected; repeated rows are judged alike, each by itself; an empty table gives an empty table; columns other
than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE_CLASS, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. Parts are of 1."""

    min_words: int = 50
    max_repeated_percent: int = 50
    #: Least part of the text, in characters of words, that the kept lines must hold.
    min_kept: float = 0.5
    #: A line fails with more symbols, repeated exclamation or separators a word than this.
    max_symbols: float = 0.3
    max_shouts: float = 0.3
    max_separators: float = 0.3
    #: A line of at least ``repeat_from`` words fails if more of them than this equal the word before.
    max_echo: float = 0.3
    repeat_from: int = 6
    #: Lines up to this many words may lack an end mark (headings); longer ones may not.
    heading_words: int = 12


#: Phrases of site and legal notices, matched in any case.
NOTICES = (
    "all rights reserved",
    "privacy policy",
    "terms of (?:use|service)",
    "cookie (?:policy|settings|notice)",
    "use of cookies",
    "enable javascript",
    "click here",
    "subscribe to (?:our|the)",
    "sign up for",
    "lorem ipsum",
    "licensed under",
    "released under the",
    "skip to (?:main )?content",
)
END_MARK = r"[.!?…:;。！？؟][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SEPARATOR = r"[|»•·>]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, rules: QualityRules) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule."""

    def judged(w: Column) -> Column:
        n = F.size(w)
        echo = F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))
        punctuation = (n > rules.heading_words) & ~line.rlike(END_MARK)
        symbols = _count(line, r"[#*$%&<>]+") > n * rules.max_symbols
        shouts = _count(line, r"[!?]{2,}") > n * rules.max_shouts
        navigation = _count(line, SEPARATOR) > n * rules.max_separators
        notice = line.rlike("(?i)(?:" + "|".join(NOTICES) + ")")
        repeated = (n >= rules.repeat_from) & (echo > n * rules.max_echo)
        return punctuation | symbols | shouts | navigation | notice | repeated

    return F.element_at(F.transform(F.array(words(line)), judged), 1)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``_n_repeat``: words within 3-word windows that occur twice or more in the text.

    Windows are sorted by hash with their places, so equal ones are neighbours; n log n for a text of n words.
    """
    w = F.col("_w")
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", hashes)
    h = F.col("_h")
    placed = F.when(
        F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("_s", placed)
    s = F.col("_s")
    twin = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_d", F.sort_array(F.transform(twin, lambda x: x["i"])))
    d = F.col("_d")
    # A window covers three words; of two that start closer together, the first adds only the words before the second.
    covered = F.transform(d, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - x, F.lit(3))))
    return df.withColumn("_n_repeat", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"))


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each document: the base counts, the parts lost to line rules, and the verdicts."""
    text = F.col("_text")
    df = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    df = df.withColumn("_w", words(text))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeat_words(df)
    chars = lambda lines: F.length(F.regexp_replace(F.array_join(lines, ""), SPACE_CLASS + "+", ""))
    good = F.filter(F.col("_lines"), lambda x: ~line_fails(x, rules))
    df = df.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_n_repeat").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        good.alias("_good"),
    )
    df = df.withColumn("n_kept_lines", F.size("_good").cast("long")).withColumn("kept_chars", chars(F.col("_good")).cast("long")).drop("_good")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeated_percent * F.col("n_words"))
    enough = F.col("kept_chars") >= F.col("word_chars") * rules.min_kept
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & enough & (F.col("n_kept_lines") > 0)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_kept_lines", "kept_chars"
    )


def clean_lines(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents with failing lines removed from ``text``; lines without a word stay."""
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~line_fails(x, rules))
    return docs.withColumn("text", F.array_join(lines, "\n"))
