"""The eleven external types: size, range, default fill, and the Spark type that holds each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ExternalType:
    name: str
    code: int
    size: int
    spark: T.DataType
    #: Least and largest value; None for text and floating types without a check.
    low: int | float | None
    high: int | float | None
    fill: int | float | str
    #: numpy's name of the big-endian external form.
    numpy: str
    #: Only in the newest of the three file formats.
    wide: bool = False


FLOAT_MAX = 3.4028234663852886e38
# Fixed values of the file format: codes, sizes, ranges and default fills.
TYPES: dict[str, ExternalType] = {
    t.name: t
    for t in (
        ExternalType("byte", 1, 1, T.ByteType(), -128, 127, -127, ">i1"),
        ExternalType("char", 2, 1, T.StringType(), None, None, "\x00", "S1"),
        ExternalType("short", 3, 2, T.ShortType(), -32768, 32767, -32767, ">i2"),
        ExternalType("int", 4, 4, T.IntegerType(), -2147483648, 2147483647, -2147483647, ">i4"),
        ExternalType("float", 5, 4, T.FloatType(), -FLOAT_MAX, FLOAT_MAX, 9.9692099683868690e36, ">f4"),
        ExternalType("double", 6, 8, T.DoubleType(), None, None, 9.9692099683868690e36, ">f8"),
        ExternalType("ubyte", 7, 1, T.ShortType(), 0, 255, 255, ">u1", True),
        ExternalType("ushort", 8, 2, T.IntegerType(), 0, 65535, 65535, ">u2", True),
        ExternalType("uint", 9, 4, T.LongType(), 0, 4294967295, 4294967295, ">u4", True),
        ExternalType("int64", 10, 8, T.LongType(), -9223372036854775808, 9223372036854775807, -9223372036854775806, ">i8", True),
        ExternalType("uint64", 11, 8, T.DecimalType(20, 0), 0, 18446744073709551615, 18446744073709551614, ">u8", True),
    )
}
BY_CODE = {t.code: t for t in TYPES.values()}
FORMATS = (1, 2, 5)


def valid_for(name: str, version: int) -> bool:
    """Whether a file format knows a type."""
    return name in TYPES and (version == 5 or not TYPES[name].wide)
