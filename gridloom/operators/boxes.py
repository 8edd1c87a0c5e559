"""Boxes: intersection of what readers ask for with what writers hold, coverage, runs of places.

The join of boxes is an equi-join on cells of a grid over the one or two axes on which boxes are short, with the overlap of all axes as residual
condition. Boxes are classed by length: one of a length up to ``4 ** k`` lies in at most two cells of that width, and meets others in cells as
wide as the longer of both, so a box of any length among short ones costs a few rows and draws none of them together. A pair
is kept only in the cell where its overlap begins, so no distinct is needed.

Work along the order of places (runs, groups) is done within ranges of places, and carried from range to range over one row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.plans.errors import OverlapError

#: Axes of the grid at most, and the longest mean length, as part of an axis, at which an axis tells boxes apart.
GRID_AXES, LONGEST = 2, 0.5


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _class(length: Column) -> Column:
    """The least k with ``length <= 4 ** k``."""
    return F.when(length <= 1, 0).otherwise((F.length(F.bin(length - 1)) + 1) / 2).cast("int")


def _grid(r: DataFrame, w: DataFrame, ndims: int) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """The axes of the grid, and the classes that reads and writes have on each; a handful of numbers from one pass over both."""
    sides = [df.select(F.lit(p).alias("side"), *[F.col(f"{p}{x}{i}").alias(f"{x}{i}") for x in "sc" for i in range(ndims)]) for df, p in ((r, "r_"), (w, "w_"))]
    row = [F.count("*").alias("n")]
    for i in range(ndims):
        s, c = F.col(f"s{i}"), F.col(f"c{i}")
        # Classes as bits of a number.
        row += [F.min(s).alias(f"lo{i}"), F.max(s + c).alias(f"hi{i}"), F.sum(c.cast("double")).alias(f"sum{i}"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _class(c))).alias(f"k{i}")]
    told = {x["side"]: x for x in sides[0].unionByName(sides[1]).groupBy("side").agg(*row).collect()}
    n = sum(x["n"] for x in told.values())
    parts = []
    for i in range(ndims):
        extent = max([x[f"hi{i}"] for x in told.values()], default=1) - min([x[f"lo{i}"] for x in told.values()], default=0)
        parts.append((sum(x[f"sum{i}"] for x in told.values()) / max(n, 1) / max(extent, 1), i))
    parts.sort()
    axes = [i for part, i in parts[:GRID_AXES] if part <= LONGEST] or [parts[0][1]]
    classes = lambda side, i: [k for k in range(64) if side in told and told[side][f"k{i}"] >> k & 1]
    return axes, [classes("r_", i) for i in axes], [classes("w_", i) for i in axes]


def _spread(df: DataFrame, p: str, axes: Sequence[int], others: Sequence[Sequence[int]], owns: Sequence[Sequence[int]]) -> DataFrame:
    """Every box in the cells, as wide as its class or a higher one of the other side, that it touches."""
    for i, other, mine in zip(axes, others, owns, strict=True):
        s, e = F.col(f"{p}s{i}"), F.col(f"{p}s{i}") + F.col(f"{p}c{i}") - 1
        if mine and other and max(mine) <= min(other) and len(other) == 1:  # all meet in cells of one width
            level = F.lit(other[0])
        elif mine and other and max(other) <= min(mine) and len(mine) == 1:
            level = F.lit(mine[0])
        else:
            own = _class(F.col(f"{p}c{i}"))
            higher = F.filter(F.array(*[F.lit(k) for k in other]).cast("array<int>"), lambda k: k > own)  # noqa: B023
            here = F.when(F.lit(min(other, default=99)) <= own, F.array(own)).otherwise(F.array().cast("array<int>"))
            df = df.withColumn("_m", F.explode(F.concat(here, higher)))
            level = F.col("_m")
        df = df.withColumn(f"_m{i}", level).withColumn(f"_b{i}", F.explode(F.sequence(F.call_function("shiftright", s, 2 * level), F.call_function("shiftright", e, 2 * level))))
    return df.drop("_m")


def _met(r: DataFrame, w: DataFrame, ndims: int, on: Sequence[str] = (), width: int | None = None) -> tuple[DataFrame, list[Column], list[Column]]:
    """Rows of ``r`` (r_s.., r_c..) and ``w`` (w_s.., w_c..), with all their columns, whose boxes overlap, and the edges of the overlap.

    With ``width`` the grid is that of the first axis, in ranges of this width.
    """
    full = lambda df, p: df.filter(reduce(lambda a, b: a & b, [F.col(f"{p}c{i}") > 0 for i in range(ndims)]))
    r, w = full(r, "r_"), full(w, "w_")
    lo = [F.greatest(f"r_s{i}", f"w_s{i}") for i in range(ndims)]
    hi = [F.least(F.col(f"r_s{i}") + F.col(f"r_c{i}"), F.col(f"w_s{i}") + F.col(f"w_c{i}")) for i in range(ndims)]
    hit = reduce(lambda a, b: a & b, [x < y for x, y in zip(lo, hi, strict=True)])
    if width:
        at = lambda df, p: df.withColumn("_b", F.explode(F.sequence(_div(F.col(f"{p}s0"), width), _div(F.col(f"{p}s0") + F.col(f"{p}c0") - 1, width))))
        return at(r, "r_").join(at(w, "w_"), [*on, "_b"]).filter(hit & (F.col("_b") == _div(lo[0], width))), lo, hi
    axes, of_r, of_w = _grid(r, w, ndims)
    r, w = _spread(r, "r_", axes, of_w, of_r), _spread(w, "w_", axes, of_r, of_w)
    for i, a, b in zip(axes, of_r, of_w, strict=True):  # in cells as wide as the longer one's class, and there where the overlap begins
        if len(a) > 1 or len(b) > 1:
            hit = hit & (F.col(f"_m{i}") == F.greatest(_class(F.col(f"r_c{i}")), _class(F.col(f"w_c{i}"))))
        hit = hit & (F.col(f"_b{i}") == F.call_function("shiftright", lo[i], 2 * F.col(f"_m{i}")))
    return r.join(w, [*on, *[f"_{x}{i}" for i in axes for x in "mb"]]).filter(hit), lo, hi


def box_join(reads: DataFrame, writes: DataFrame, ndims: int, on: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """A row (r_id, w_id, lo.., hi..) for each read and write whose boxes overlap.

    ``reads`` and ``writes`` have ``id``, ``s0..`` and ``c0..``, and the equi-join columns ``on``. Boxes of rank 0 always overlap.
    """
    named = lambda df, p: df.select(*on, F.col("id").alias(f"{p}id"), *[F.col(f"{x}{i}").alias(f"{p}{x}{i}") for x in "sc" for i in range(ndims)])
    r, w = named(reads, "r_"), named(writes, "w_")
    if ndims == 0:
        return r.join(w, list(on)) if on else r.crossJoin(w)  # both sides are single cells
    met, lo, hi = _met(r, w, ndims, on, width)
    return met.select(*on, "r_id", "w_id", *[x.alias(f"lo{i}") for i, x in enumerate(lo)], *[x.alias(f"hi{i}") for i, x in enumerate(hi)])


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, ndims: int, on: Sequence[str]) -> DataFrame:
    """Cells (d0.. and more) joined with the boxes (lo.., hi.. and more) of the same ``on`` that hold them; both keep their columns."""
    if ndims == 0:
        return cells.join(boxes, list(on))
    points = cells.withColumns({f"r_s{i}": F.col(f"d{i}") for i in range(ndims)} | {f"r_c{i}": F.lit(1).cast("long") for i in range(ndims)})
    spans = boxes.withColumns({f"w_s{i}": F.col(f"lo{i}") for i in range(ndims)} | {f"w_c{i}": F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(ndims)})
    return _met(points, spans, ndims, on)[0].select(*cells.columns, *[c for c in boxes.columns if c not in on])


def stab(points: DataFrame, boxes: DataFrame, ndims: int, on: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """The boxes that hold each point (id, d0..)."""
    as_boxes = points.select(*on, "id", *[F.col(f"d{i}").alias(f"s{i}") for i in range(ndims)], *[F.lit(1).cast("long").alias(f"c{i}") for i in range(ndims)])
    return box_join(as_boxes, boxes, ndims, on, width).select(*on, F.col("r_id").alias("point_id"), F.col("w_id").alias("box_id"))


def volume(ndims: int, lo: str = "lo", hi: str = "hi") -> Column:
    """Elements of a box given by its edges."""
    return reduce(lambda a, b: a * b, [F.col(f"{hi}{i}") - F.col(f"{lo}{i}") for i in range(ndims)], F.lit(1).cast("long"))


def size(ndims: int) -> Column:
    """Elements of a box given by its counts."""
    return reduce(lambda a, b: a * b, [F.col(f"c{i}") for i in range(ndims)], F.lit(1).cast("long"))


def coverage(reads: DataFrame, plan: DataFrame, ndims: int) -> DataFrame:
    """(id, requested, matched, complete) of each read, for writes that do not overlap each other."""
    got = plan.groupBy(F.col("r_id").alias("id")).agg(F.sum(volume(ndims)).alias("matched"))
    told = reads.select("id", size(ndims).alias("requested")).join(got, "id", "left")
    return told.select("id", "requested", F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), (F.coalesce("matched", F.lit(0)) == F.col("requested")).alias("complete"))


def distinct_coverage(reads: DataFrame, plan: DataFrame, ndims: int) -> DataFrame:
    """As :func:`coverage`, for writes that may overlap each other: each place counts once.

    Pieces are merged as runs along the last axis, for each index on the axes before it.
    """
    pieces, outer = plan, [f"x{i}" for i in range(ndims - 1)]
    for i, x in enumerate(outer):
        pieces = pieces.withColumn(x, F.explode(F.sequence(F.col(f"lo{i}"), F.col(f"hi{i}") - 1)))
    n = ndims - 1
    pieces = pieces.select(F.col("r_id").alias("id"), *outer, F.col(f"lo{n}").alias("offset"), (F.col(f"hi{n}") - F.col(f"lo{n}")).alias("len")).distinct()
    got = coalesce_runs(pieces, ["id", *outer]).groupBy("id").agg(F.sum("len").alias("matched"))
    told = reads.select("id", size(ndims).alias("requested")).join(got, "id", "left")
    return told.select("id", "requested", F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), (F.coalesce("matched", F.lit(0)) == F.col("requested")).alias("complete"))


def resolve(cells: DataFrame, keys: Sequence[str], on_overlap: str = "last", seq: str = "seq") -> DataFrame:
    """One row for each place: that of the last or first write; ``error`` raises if a place is written twice.

    The extreme is found by partial aggregation, so a place written very often is no hot spot.
    """
    if on_overlap == "error":
        twice = cells.groupBy(*keys).count().filter("count > 1").limit(1).collect()
        if twice:
            raise OverlapError(f"place {[twice[0][k] for k in keys]} is written {twice[0]['count']} times")
        return cells
    rest = [c for c in cells.columns if c not in keys]
    pick = F.max_by if on_overlap == "last" else F.min_by
    return cells.groupBy(*keys).agg(pick(F.struct(*rest), F.col(seq)).alias("_v")).select(*keys, "_v.*")


def split_by_owner(requests: DataFrame, ndims: int, shape0: int, owners: int, block: int | None = None) -> DataFrame:
    """Requests cut at the edges of the first axis' owner ranges, with ``owner``.

    A rank under 2 goes whole to one owner by its variable; an unlimited axis (``shape0`` 0) is dealt by single places.
    """
    if ndims < 2:
        return requests.withColumn("owner", F.pmod(F.col("varid"), F.lit(owners)).cast("long"))
    b = block or (max(1, -(-shape0 // owners)) if shape0 else 1)
    cut = requests.filter("c0 > 0").withColumn("_k", F.explode(F.sequence(_div(F.col("s0"), b), _div(F.col("s0") + F.col("c0") - 1, b))))
    lo, hi = F.greatest(F.col("s0"), F.col("_k") * b), F.least(F.col("s0") + F.col("c0"), (F.col("_k") + 1) * b)
    return cut.withColumns({"s0": lo, "c0": hi - lo, "owner": F.pmod("_k", F.lit(owners)).cast("long")}).drop("_k")


def runs(boxes: DataFrame, shape: Sequence[int], element: int = 1, stride: Sequence[int] | None = None) -> DataFrame:
    """(id, seq, offset, len, buf): the row-major runs of each box, in bytes of ``element`` size, and their place in its buffer."""
    n = len(shape)
    step = list(stride or [1] * n)
    whole = step[-1] == 1
    cells = boxes
    outer = range(n - 1) if whole else range(n)
    for i in outer:
        cells = cells.filter(F.col(f"c{i}") > 0).withColumn(f"k{i}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"c{i}") - 1)))
    cells = cells.filter(F.col(f"c{n - 1}") > 0)
    k = [F.col(f"k{i}") if i in outer else F.lit(0).cast("long") for i in range(n)]
    offset = sum(((F.col(f"s{i}") + k[i] * step[i]) * prod(shape[i + 1 :]) for i in range(n)), F.lit(0).cast("long"))
    place = F.lit(0).cast("long")
    for i in range(n):
        place = place * F.col(f"c{i}") + k[i]
    length = F.col(f"c{n - 1}") if whole else F.lit(1).cast("long")
    return cells.select("id", (offset * element).alias("offset"), (length * element).alias("len"), (place * element).alias("buf"))


def coalesce_runs(pieces: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Runs (offset, len) merged where they touch or overlap, as (offset, len, n): gaps and islands over each group."""
    order = W.partitionBy(*group).orderBy("offset", "len") if group else W.orderBy("offset", "len")
    reach = F.max(F.col("offset") + F.col("len")).over(order.rowsBetween(W.unboundedPreceding, -1))
    told = pieces.withColumn("_new", F.coalesce(F.col("offset") > reach, F.lit(True)).cast("int"))
    told = told.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = told.groupBy(*group, "_island").agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("len")).alias("_end"), F.count("*").alias("n"))
    return merged.select(*group, "offset", (F.col("_end") - F.col("offset")).alias("len"), "n")


#: Ranges that are merged into one in each pass.
_MERGE = 64


def coalesce_runs_distributed(pieces: DataFrame, width: int) -> DataFrame:
    """As :func:`coalesce_runs` without groups, for any number of runs: merged within ranges of about ``width`` places, then ranges of ranges.

    Runs are cut at the edges of ranges. What touches an edge, two islands a range at most, goes on to the next pass, in which
    ranges are 64 times as wide; the others are done. Passes grow with the logarithm of the extent, and no task sees more than a range.
    """
    row = pieces.filter("len > 0").agg(F.avg("len").alias("mean"), F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("len")).alias("hi")).first()
    if row["hi"] is None:
        return pieces.filter("len > 0").select("offset", "len")
    width = max(width, int(row["mean"]))  # a run is cut into few
    done, left = None, pieces.filter("len > 0").select("offset", "len")
    while True:
        at = F.explode(F.sequence(_div(F.col("offset"), width), _div(F.col("offset") + F.col("len") - 1, width)))
        cut = left.select("offset", "len", at.alias("_k"))
        lo, hi = F.greatest(F.col("offset"), F.col("_k") * width), F.least(F.col("offset") + F.col("len"), (F.col("_k") + 1) * width)
        within = coalesce_runs(cut.select("_k", lo.alias("offset"), (hi - lo).alias("len")), ["_k"])
        whole = row["lo"] // width == (row["hi"] - 1) // width
        edge = F.lit(False) if whole else (F.pmod("offset", F.lit(width)) == 0) | (F.pmod(F.col("offset") + F.col("len"), F.lit(width)) == 0)
        ended = within.filter(~edge).select("offset", "len")
        done = ended if done is None else done.unionByName(ended)
        if whole:
            return done
        left, width = within.filter(edge).select("offset", "len"), width * _MERGE


#: Ranges of places over which running results are carried, one row each.
_RANGES = 4096


def _carried(df: DataFrame, at: str, ties: Sequence[str], value: Column, how, name: str, before_only: bool = True) -> DataFrame:
    """``df`` with ``how`` (max or sum) of ``value`` over all rows that come earlier by ``at`` and then ``ties``, or so far.

    Rows are put in ranges of equal width of ``at``. Within a range a window does it; from range to range one row each is summed up.
    """
    ends = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    lo, width = (ends["lo"], (ends["hi"] - ends["lo"]) // _RANGES + 1) if ends["lo"] is not None else (0, 1)
    df = df.withColumns({"_v": value, "_k": _div(F.col(at) - lo, width)})
    per = df.groupBy("_k").agg(how("_v").alias("_top"))
    earlier = per.select(F.col("_k").alias("_k2"), how("_top").over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))  # 4096 rows at most
    window = W.partitionBy("_k").orderBy(at, *ties).rowsBetween(W.unboundedPreceding, -1 if before_only else 0)
    joined = df.withColumn("_here", how("_v").over(window)).join(F.broadcast(earlier), F.col("_k") == F.col("_k2"))
    both = F.greatest("_here", "_carry") if how is F.max else F.coalesce("_here", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return joined.withColumn(name, both).drop("_v", "_k", "_k2", "_here", "_carry")


def trim_runs(pieces: DataFrame) -> DataFrame:
    """Runs (id, offset, len, buf) after the earlier ones have taken what is contested: later ones are trimmed, and dropped if nothing is left."""
    told = _carried(pieces, "offset", ["len", "id"], F.col("offset") + F.col("len"), F.max, "_reach")
    told = told.withColumn("_cut", F.greatest(F.lit(0).cast("long"), F.coalesce("_reach", F.col("offset")) - F.col("offset"))).filter("_cut < len")
    return told.select("id", (F.col("offset") + F.col("_cut")).alias("offset"), (F.col("len") - F.col("_cut")).alias("len"), (F.col("buf") + F.col("_cut")).alias("buf"))


def interleave_groups(spans: DataFrame) -> DataFrame:
    """Requests (id, first, end) with ``grp``: requests whose spans reach into each other share one. Groups count from 1 in the order of places."""
    told = _carried(spans, "first", ["end", "id"], F.col("end"), F.max, "_reach")
    told = told.withColumn("_new", F.coalesce(F.col("first") >= F.col("_reach"), F.lit(True)).cast("long"))
    return _carried(told, "first", ["end", "id"], F.col("_new"), F.sum, "grp", before_only=False).drop("_new", "_reach")
