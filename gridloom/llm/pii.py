"""Operator 4, personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Base kinds (email, ip, card, phone) stand on their pattern and check alone. Further kinds carry a score: a valid
checksum (mod 97 of an IBAN) confirms one; a weaker pattern (social security number, national phone number, secret)
starts low and needs a fitting word nearby. Spans under ``min_score`` are left out.

Spark's regular expressions return matches, not places. Splitting a text by the same pattern gives the pieces in
between, so running sums of the lengths of pieces and matches give every place, in code points, without Python. The patterns are
written so that a failing start costs no more than the run of characters it stands in, and that numbers of a wrong length do not
match at all, so the work is in proportion to a text's length but for the sums, which cost the root of the number of matches more.

Defined cases: a null or empty text has no spans; of spans of one kind none overlap, and spans of different kinds that overlap or start
together are all reported, in order of their kind; a national number within an international one is not; repeated rows are treated alike, each by itself; an empty table
gives an empty table; columns other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, running

#: Patterns. Runs are possessive, and a search starts only where a run starts or the last match ended (\G).
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of digits with single separators, if it has 13 to 19 of them.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
#: A whole run up to its last digit, if it has 9 to 15 digits.
PHONE = r"\+(?=[0-9])(?:[\x20().-]*+[0-9]){9,15}+(?![\x20().-]*+[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: A last word of a match that may be no part of the number: a currency, the word BIC, a BIC itself.
IBAN_TAIL = r"\x20[A-Z0-9]*[A-Z][A-Z0-9]*$"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: As an alternative to the international form, within which it is no find of its own.
LOCAL_PHONE = PHONE + r"|(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
_SECRET_WORD = r"(?i:token|secret|passwd|password|api[_-]?key)"
SECRET = _SECRET_WORD + r"[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9_+/.-]{16,}"

#: Kinds in their order within ``spans``.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
#: Words that raise a score when found near a span, and the score without and the gain with them.
CONTEXT = {
    "iban": (r"iban|konto|account|bank", 0.9, 0.1),
    "ssn": (r"ssn|social|security|sozialvers", 0.4, 0.4),
    "local_phone": (r"phone|tel|call|fax|mobile|cell", 0.4, 0.4),
    "secret": (r"token|secret|password|key", 0.4, 0.4),
}
#: Characters before and after a span in which those words count.
BEFORE, AFTER = 48, 24

_SPAN = "array<struct<s:int,e:int,m:string,near:string>>"


def _matches(text: Column, pattern: str, context: bool = False) -> Column:
    """Every match of ``pattern`` with its start, end and, if asked for, the text nearby."""

    def placed(ms: Column) -> Column:
        def by(pieces: Column) -> Column:
            ends = running(F.transform(ms, lambda m, i: F.length(F.get(pieces, i)) + F.length(m)), lambda a, x: a + x, F.lit(0))

            def spans(e: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    near = F.lower(F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(BEFORE)), F.left(F.get(pieces, i + 1), F.lit(AFTER)))) if context else F.lit("")
                    return F.struct((F.get(e, i) - F.length(m)).alias("s"), F.get(e, i).alias("e"), m.alias("m"), near.alias("near"))

                return F.transform(ms, one)

            return let(ends, spans)

        return F.when(F.size(ms) > 0, let(F.split(text, pattern, -1), by)).otherwise(F.array().cast(_SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    number = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    summed = F.aggregate(F.transform(number, lambda d, i: F.when(i % 2 == 1, double(d)).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return summed % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's number, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    step = lambda a, c: let(F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _without_tail(x: Column) -> Column:
    """The span of an IBAN without those last words that the pattern took in and with which its check fails."""
    shorter = lambda m, _: F.when(mod97(m), m).otherwise(F.regexp_replace(m, IBAN_TAIL, ""))
    best = F.aggregate(F.sequence(F.lit(1), F.lit(8)), x["m"], shorter)  # a match has no more words than groups and a tail
    near = lambda m: F.concat_ws(" ", x["near"], F.lower(F.substring(x["m"], F.length(m) + 1, F.length(x["m"]))))
    return let(best, lambda m: F.struct(x["s"].alias("s"), (x["s"] + F.length(m)).alias("e"), m.alias("m"), near(m).alias("near")))


def _part_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def findings(docs: DataFrame, min_score: float = 0.6, keep_text: bool = False) -> DataFrame:
    """doc_id and, for each kind, an array of its spans (s, e, m, near) that hold, in order of their start."""
    text = F.col("_text")
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))

    def scored(kind: str, spans: Column) -> Column:
        near, base, gain = CONTEXT[kind]
        return F.filter(spans, lambda x: (F.lit(base) + F.when(x["near"].rlike(near) | (x["m"].rlike(f"(?i){near}") if kind == "secret" else F.lit(False)), gain).otherwise(0.0)) >= min_score)

    digit = text.rlike("[0-9]")
    only = lambda gate, spans: F.when(gate, spans).otherwise(F.array().cast(_SPAN))
    df = df.withColumns(
        {
            "email": only(F.instr(text, "@") > 0, _matches(text, EMAIL)),
            "ip": only(digit, F.filter(_matches(text, IP), lambda x: _part_ok(x["m"]))),
            "card": only(digit, F.filter(_matches(text, CARD), lambda x: luhn(_digits(x["m"])))),
            "phone": only(F.instr(text, "+") > 0, _matches(text, PHONE)),
            "iban": only(digit, scored("iban", F.filter(F.transform(_matches(text, IBAN, True), _without_tail), lambda x: mod97(x["m"]) & x["m"].rlike(f"^{IBAN}$")))),
            "ssn": only(digit, scored("ssn", F.filter(_matches(text, SSN, True), lambda x: ~x["m"].rlike("^(?:000|666|9)|-00-|-0000$")))),
            "local_phone": only(digit, scored("local_phone", F.filter(_matches(text, LOCAL_PHONE, True), lambda x: ~F.startswith(x["m"], F.lit("+"))))),
            "secret": only(text.rlike(_SECRET_WORD), scored("secret", _matches(text, SECRET, True))),
        }
    )
    # A secret's span is its value, the end of the match.
    value = lambda x: F.struct((x["e"] - F.length(F.regexp_extract(x["m"], "[A-Za-z0-9_+/.-]+$", 0))).alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["near"].alias("near"))
    return df.withColumn("secret", F.transform("secret", value)).drop(*[] if keep_text else ["_text"])


def pii_report(docs: DataFrame, min_score: float = 0.6) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans as text."""

    def listed(kinds: tuple[str, ...]) -> Column:
        label = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"], x["e"]))
        return F.array_join(F.concat(*[label(k) for k in kinds]), ",")

    found = findings(docs, min_score)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], F.sha2(listed(KINDS[:4]), 256).alias("base_sha256"), listed(KINDS).alias("spans")
    )


#: Characters of the parts that a text is cut into before pieces are taken out of it: to find a place costs no more than one part.
_PART = 4096


def redact(docs: DataFrame, min_score: float = 0.6) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets; spans that overlap are one, of the first's kind."""
    found = findings(docs, min_score, keep_text=True)
    named = lambda kind: F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k")))
    marks, parts, reach = F.col("_marks"), F.col("_parts"), F.col("_reach")
    found = found.select("doc_id", F.length("_text").alias("_n"), F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)).alias("_parts"), F.array_sort(F.concat(*[named(k) for k in KINDS])).alias("_marks"))
    found = found.withColumn("_reach", running(F.transform(marks, lambda m: m["e"]), F.greatest, F.lit(0)))
    # A mark that starts before the end of an earlier one belongs to it.
    before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
    heads = F.filter(F.transform(marks, lambda m, i: F.struct(m["s"].alias("s"), m["k"].alias("k"), before(i).alias("at"))), lambda m: m["s"] >= m["at"])

    def between(a: Column, b: Column) -> Column:
        """The text from a to b."""
        i, j = F.floor(a / _PART).cast("int"), F.floor(b / _PART).cast("int")
        inside = F.substr(F.get(parts, i), a - i * _PART + 1, b - a)
        across = F.concat(F.substr(F.get(parts, i), a - i * _PART + 1), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.coalesce(F.substr(F.get(parts, j), F.lit(1), b - j * _PART), F.lit("")))
        return F.when(a >= b, F.lit("")).when(i == j, inside).otherwise(across)

    pieces = F.transform(heads, lambda m: F.concat(between(m["at"], m["s"]), F.lit("<"), m["k"], F.lit(">")))
    last = F.coalesce(F.get(reach, F.size(reach) - 1), F.lit(0))
    return found.select("doc_id", F.concat(F.array_join(pieces, ""), between(last, F.col("_n"))).alias("text"))
