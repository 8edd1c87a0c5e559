"""Selections: single elements, boxes, strided and remapped boxes, lists of boxes and of places.

A selection is checked against its variable's shape first, in a fixed order of errors, and then becomes predicates on the
index columns, which Spark pushes to the scan. Results are re-based: their index counts from 0 within the selection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.index import dims, linear
from gridloom.operators.boxes import GRID_AXES, LONGEST, resolve
from gridloom.plans.errors import ArrayError


def validate(
    shape: Sequence[int], start: Sequence[int], count: Sequence[int] | None = None, stride: Sequence[int] | None = None, *,
    record: bool = False, numrecs: int = 0, writing: bool = False, version: int = 5,
) -> None:
    """Raises the error of the first check that a request fails.

    With ``record``, axis 0 is unlimited: reads end at ``numrecs``, writes may extend it.
    """
    if not len(shape):
        return
    count = count if count is not None else [1] * len(shape)
    for i, n in enumerate(shape):
        s, c, t = start[i], count[i], stride[i] if stride is not None else 1
        unlimited = record and i == 0
        if s < 0:
            raise ArrayError("NC_EINVALCOORDS", f"axis {i}")
        if unlimited:
            if version != 5 and s > 2**32 - 1:
                raise ArrayError("NC_EINVALCOORDS", f"axis {i}")
            if c < 0:
                raise ArrayError("NC_ENEGATIVECNT", f"axis {i}")
            if not writing and s >= numrecs:
                raise ArrayError("NC_EINVALCOORDS", f"axis {i}")
            if t == 0:
                raise ArrayError("NC_ESTRIDE", f"axis {i}")
            if not writing and s + max(c - 1, 0) * t + bool(c) > numrecs:
                raise ArrayError("NC_EEDGE", f"axis {i}")
        else:
            if s >= n:
                raise ArrayError("NC_EINVALCOORDS", f"axis {i}")
            if c < 0:
                raise ArrayError("NC_ENEGATIVECNT", f"axis {i}")
            if c > n or (c and s + (c - 1) * t + 1 > n):
                raise ArrayError("NC_EEDGE", f"axis {i}")
        if t < 1:
            raise ArrayError("NC_ESTRIDE", f"axis {i}")


def in_box(start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None, names: Sequence[str] | None = None) -> Column:
    """The predicate of a box."""
    hit = F.lit(True)
    for i, (s, c) in enumerate(zip(start, count, strict=True)):
        t, x = stride[i] if stride else 1, F.col(names[i] if names else f"d{i}")
        hit = hit & (x >= s) & (x <= s + (c - 1) * t if c else F.lit(False))
        if t > 1:
            hit = hit & (F.pmod(x - s, F.lit(t)) == 0)
    return hit


def rebased(v: DataFrame, start: Sequence[int], stride: Sequence[int] | None = None) -> DataFrame:
    """Indices counted from ``start`` in steps of ``stride``."""
    moved = {f"d{i}": (F.call_function("div", F.col(f"d{i}") - s, F.lit(stride[i]).cast("long")) if stride else F.col(f"d{i}") - s).cast("long") for i, s in enumerate(start)}
    return v.withColumns(moved) if moved else v


def var(v: DataFrame) -> DataFrame:
    """A whole variable."""
    return v


def var1(v: DataFrame, index: Sequence[int], shape: Sequence[int] | None = None, **checks) -> DataFrame:
    """One element."""
    if shape is not None:
        validate(shape, index, **checks)
    return v.filter(in_box(index, [1] * len(index))).select("value")


def vara(v: DataFrame, start: Sequence[int], count: Sequence[int], shape: Sequence[int] | None = None, **checks) -> DataFrame:
    """A box."""
    return vars_(v, start, count, None, shape, **checks)


def vars_(v: DataFrame, start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None, shape: Sequence[int] | None = None, **checks) -> DataFrame:
    """A strided box."""
    if shape is not None:
        validate(shape, start, count, stride, **checks)
    return rebased(v.filter(in_box(start, count, stride)), start, stride)


def contiguous_map(count: Sequence[int]) -> list[int]:
    """The index map of a buffer in row-major order."""
    return [prod(count[i + 1 :]) for i in range(len(count))]


def varm(
    v: DataFrame, start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None, imap: Sequence[int], shape: Sequence[int] | None = None, **checks
) -> DataFrame:
    """A strided box with the place ``m`` of each element in a buffer laid out by ``imap``, in elements."""
    box = vars_(v, start, count, stride, shape, **checks)
    place = F.lit(0).cast("long")
    for i, step in enumerate(imap):
        place = place + F.col(f"d{i}") * step
    return box.withColumn("m", place)


def transposed(v: DataFrame, axes: Sequence[int]) -> DataFrame:
    """A variable with its axes in another order: axis ``i`` of the result is axis ``axes[i]``."""
    return v.select(*[F.col(f"d{a}").alias(f"d{i}") for i, a in enumerate(axes)], *[c for c in v.columns if c not in dims(len(axes))])


def without_halo(v: DataFrame, shape: Sequence[int], halo: int) -> DataFrame:
    """The inside of an array with ghost cells on all sides, re-based."""
    return vara(v, [halo] * len(shape), [n - 2 * halo for n in shape], shape)


def fortran(*index: Sequence[int], one_based: bool = True) -> list[list[int]]:
    """Starts, counts or strides in Fortran's order of axes, reversed; the first, if 1-based, is a start."""
    return [[x - (one_based and k == 0) for x in reversed(ix)] for k, ix in enumerate(index)]


def boxes_frame(spark, starts: Sequence[Sequence[int]], counts: Sequence[Sequence[int] | None]) -> DataFrame:
    """(seq, s0.., c0..) of a list of boxes; a missing count is 1 everywhere."""
    n = len(starts[0])
    rows = [(j, *s, *(c if c is not None else [1] * n)) for j, (s, c) in enumerate(zip(starts, counts, strict=True))]
    return spark.createDataFrame(rows, ", ".join(["seq long", *[f"s{i} long" for i in range(n)], *[f"c{i} long" for i in range(n)]]))


def _cells(counts: Sequence[Sequence[int]], extent: Sequence[int]) -> dict[int, int]:
    """The axes on which a list of boxes is short within its hull, two at most, and the mean length there: a box touches about two cells on each."""
    mean = [sum(c[i] for c in counts) / len(counts) for i in range(len(extent))]
    axes = sorted(range(len(extent)), key=lambda i: mean[i] / max(1, extent[i]))[:GRID_AXES]
    return {i: max(1, ceil(mean[i])) for i in [a for a in axes if mean[a] <= LONGEST * extent[a]] or axes[:1]}


def varn(v: DataFrame, starts: Sequence[Sequence[int]], counts: Sequence[Sequence[int] | None], shape: Sequence[int] | None = None, **checks) -> DataFrame:
    """A list of boxes: each element once for each box that holds it, with the box ``seq``, its index there, and ``place``, its place in that box."""
    n = len(starts[0])
    full = [c if c is not None else [1] * n for c in counts]
    if shape is not None:
        for s, c in zip(starts, full, strict=True):
            validate(shape, s, c, **checks)
    spark = v.sparkSession
    boxes = boxes_frame(spark, starts, full)
    inside = F.lit(True)
    for i in range(n):
        inside = inside & (F.col(f"d{i}") >= F.col(f"s{i}")) & (F.col(f"d{i}") < F.col(f"s{i}") + F.col(f"c{i}"))
    low = [min(s[i] for s in starts) for i in range(n)]
    high = [max(s[i] + c[i] for s, c in zip(starts, full, strict=True)) for i in range(n)]
    hull = v.filter(in_box(low, [h - lo for lo, h in zip(low, high, strict=True)]))  # reaches the scan
    if n == 0:
        met = hull.crossJoin(boxes)  # a single cell
    else:
        # An equi-join on cells of a grid; the list came from the driver, so Spark broadcasts it if it is small.
        spread = boxes.filter(reduce(lambda a, b: a & b, [F.col(f"c{i}") > 0 for i in range(n)]))
        cells = _cells(full, [h - lo for lo, h in zip(low, high, strict=True)])
        for i, width in cells.items():
            at = lambda x, by=width: F.call_function("div", x, F.lit(by).cast("long"))
            spread = spread.withColumn(f"_b{i}", F.explode(F.sequence(at(F.col(f"s{i}")), at(F.col(f"s{i}") + F.col(f"c{i}") - 1))))
            hull = hull.withColumn(f"_b{i}", at(F.col(f"d{i}")))
        met = hull.join(spread, [f"_b{i}" for i in cells]).filter(inside)
    place = F.lit(0).cast("long")
    for i in range(n):
        place = place * F.col(f"c{i}") + (F.col(f"d{i}") - F.col(f"s{i}"))
    return met.select("seq", *[(F.col(f"d{i}") - F.col(f"s{i}")).alias(f"d{i}") for i in range(n)], place.alias("place"), "value")


def vard(v: DataFrame, shape: Sequence[int], places: DataFrame) -> DataFrame:
    """The elements at the row-major ``place`` values of a frame, in whatever pattern."""
    at = linear([F.col(f"d{i}") for i in range(len(shape))], shape)
    return v.withColumn("place", at).join(places.select("place").distinct(), "place", "left_semi")


def flexible(selected: DataFrame, wanted: int, held: int) -> tuple[DataFrame, str]:
    """A selection into a buffer of another size: the smaller of both is moved, and the status tells."""
    return selected.filter(F.col("place") < min(wanted, held)), "NC_NOERR" if wanted == held else "NC_EIOMISMATCH"


def many(requests: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """Several selections of one rank in one result, told apart by ``req_id``."""
    frames = [df.withColumn("req_id", F.lit(k).cast("long")) for k, df in requests]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def put(v: DataFrame, written: DataFrame, ndims: int, on_overlap: str = "last") -> DataFrame:
    """A variable after writes (index, value, seq); of several writes to a place the first or last counts, or it is an error."""
    keys = dims(ndims)
    new = resolve(written, keys, on_overlap).select(*keys, "value")
    return v.join(new, keys, "left_anti").select(*keys, "value").unionByName(new)


def contiguous(shape: Sequence[int], start: Sequence[int], count: Sequence[int]) -> bool:
    """Whether a box is one run in row-major order: below the first axis longer than 1 it takes all."""
    i = next((i for i, c in enumerate(count) if c != 1), len(count))
    return prod(count) == 0 or all(c == n for c, n in zip(count[i + 1 :], shape[i + 1 :], strict=True))
