"""Index arithmetic: row-major linear places, their inverse, and the block patterns of owners."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def dims(n: int) -> list[str]:
    return [f"d{i}" for i in range(n)]


def linear(index: Sequence[Column], shape: Sequence[int]) -> Column:
    """Row-major place of an index; the first length does not matter."""
    place = F.lit(0).cast("long")
    for x, n in zip(index, shape, strict=True):
        place = place * F.lit(n).cast("long") + x
    return place


def unravel(place: Column, shape: Sequence[int]) -> list[Column]:
    """The index at a row-major place; the first axis may run past its length."""
    out = []
    for i in range(len(shape)):
        below = F.lit(prod(shape[i + 1 :])).cast("long")
        x = F.call_function("div", place, below)
        out.append((x if i == 0 else F.pmod(x, F.lit(shape[i]))).cast("long"))
    return out


def owner_block(x: Column, length: int, owners: int) -> Column:
    """Owner of a place when an axis is cut into ``owners`` ranges of equal length, the last one shorter."""
    return F.floor(x / F.lit(-(-length // owners))).cast("long")


def owner_cyclic(x: Column, owners: int, block: int = 1) -> Column:
    """Owner of a place when blocks of an axis are dealt out in turn."""
    return F.pmod(F.floor(x / F.lit(block)), F.lit(owners)).cast("long")
