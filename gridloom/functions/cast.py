"""Conversions that check ranges element by element and never stop at the first error.

An element out of range gives null and the flag ``erange``; the others are converted. Overflow from double to float
is the exception: it gives the largest float of its sign, with the flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.types import FLOAT_MAX, TYPES
from gridloom.plans.errors import ArrayError


def in_range(value: Column, kind: str) -> Column:
    """Whether ``value`` fits the external type; the fraction of a number does not count."""
    t = TYPES[kind]
    if t.low is None:
        return value.isNotNull()
    if kind in ("int64", "uint64"):  # as doubles their ends are powers of two, and exact; other types compare as decimals
        low, high = (-(2.0**63), 2.0**63) if kind == "int64" else (0.0, 2.0**64)
        x, wide = value.cast("double"), F.when(~F.isnan(value.cast("double")), value).cast("decimal(38,6)")
        exact = (wide >= F.lit(str(t.low)).cast("decimal(38,6)")) & (wide < F.lit(str(t.high + 1)).cast("decimal(38,6)"))
        return F.when(F.typeof(value).isin("double", "float"), ~F.isnan(x) & (x > (low if kind == "int64" else -1.0)) & (x < high) | (x == low)).otherwise(exact)
    return ~F.isnan(value.cast("double")) & (value >= F.lit(t.low)) & (value <= F.lit(t.high))


def checked_cast(value: Column, kind: str, source: str | None = None) -> tuple[Column, Column]:
    """(converted, erange). Fractions are cut towards zero. ``source`` names the external type that ``value`` has."""
    if (kind == "char") != (source == "char"):
        raise ArrayError("NC_ECHAR")
    if kind == "char":
        return value.cast("string"), F.lit(False)
    t = TYPES[kind]
    if kind == "double":
        return value.cast("double"), F.lit(False)
    if kind == "float":
        x = value.cast("double")
        over = x.isNotNull() & ~F.isnan(x) & (F.abs(x) > F.lit(FLOAT_MAX))
        return F.when(over, F.signum(x) * F.lit(FLOAT_MAX)).otherwise(x).cast("float"), over
    fits = in_range(value, kind)
    cut = F.when(fits, F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))).cast(t.spark)
    if kind == "uint64":  # the whole part of a double can exceed a long: it is put together from two halves
        x, half = value.cast("double"), F.lit(2.0**32)
        high = F.floor(x / half)
        joined = (high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)") + F.floor(x - high * half).cast("decimal(20,0)")).cast(t.spark)
        cut = F.when(fits & F.typeof(value).isin("double", "float") & (x >= F.lit(2.0**63)), joined).otherwise(cut)
    return cut, value.isNotNull() & ~fits


def byte_bits(value: Column, unsigned: bool) -> Column:
    """A signed byte as the unsigned one of the same bits, or back; this pair has no range error."""
    return F.pmod(value.cast("int"), F.lit(256)).cast("short") if unsigned else F.when(value > 127, value - 256).otherwise(value).cast("byte")


def cast_variable(v: DataFrame, kind: str, source: str | None = None) -> DataFrame:
    """A variable with ``value`` converted and the column ``erange``."""
    value, flag = checked_cast(F.col("value"), kind, source)
    return v.withColumns({"value": value, "erange": flag})


def request_status(v: DataFrame) -> DataFrame:
    """One row, whether any element of a converted variable was out of range."""
    return v.agg(F.coalesce(F.bool_or("erange"), F.lit(False)).alias("erange"))
