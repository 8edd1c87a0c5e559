"""Non-blocking requests: a queue of lazy selections and writes that runs when it is waited for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.types import TYPES
from gridloom.operators.fill import grid
from gridloom.operators.select import put, validate, vars_, varn
from gridloom.plans.catalog import Dataset
from gridloom.plans.errors import ArrayError

ALL, ALL_GETS, ALL_PUTS = "all", "gets", "puts"


@dataclass
class Request:
    id: int
    rw: str
    var: str
    boxes: list[tuple[list[int], list[int], list[int] | None]]
    values: DataFrame | None = None
    buffered: int = 0
    #: Place in memory of a step along each axis; None is row-major.
    imap: list[int] | None = None
    #: Posted before the schema was frozen, and so not checked yet.
    unchecked: bool = False
    #: The values of a list of boxes have their index in the variable already.
    placed: bool = False


class RequestQueue:
    """Requests on a dataset. Posting only validates; :meth:`wait` builds one plan of all that it takes.

    Requests posted in define mode are checked when they are waited for; one that fails then has its error as status.
    Values are immutable, so a buffered write differs from another only in its charge to the attached buffer.
    """

    def __init__(self, dataset: Dataset):
        self.dataset = dataset
        self.pending: dict[int, Request] = {}
        self.last = 0
        self.buffer: int | None = None

    def _check(self, rw: str, var: str, boxes: list) -> None:
        s = self.dataset.schema
        for start, count, stride in boxes:
            validate(s.shape(var), start, count, stride, record=s.is_record(var), numrecs=s.numrecs, writing=rw == "w", version=s.version)

    def _post(self, rw: str, var: str, boxes: list, values: DataFrame | None = None, buffered: bool = False, imap: Sequence[int] | None = None) -> int:
        s = self.dataset.schema
        if not s.defining:
            self._check(rw, var, boxes)
        size = sum(prod(c) for _, c, _ in boxes) * TYPES[s.var(var).kind].size if buffered else 0
        if buffered:
            if self.buffer is None:
                raise ArrayError("NC_ENULLABUF")
            if self.usage() + size > self.buffer:
                raise ArrayError("NC_EINSUFFBUF")
        self.last += 1
        self.pending[self.last] = Request(self.last, rw, var, boxes, values, size, list(imap) if imap is not None else None, s.defining)
        return self.last

    def iget(
        self, var: str, start: Sequence[int] | None = None, count: Sequence[int] | None = None, stride: Sequence[int] | None = None, imap: Sequence[int] | None = None
    ) -> int:
        """A whole variable, or a box of it; with ``imap`` the places are those of a buffer laid out by it."""
        shape = self.dataset.schema.shape(var)
        start = list(start if start is not None else [0] * len(shape))
        return self._post("r", var, [(start, list(count if count is not None else shape), list(stride) if stride else None)], imap=imap)

    def iget1(self, var: str, index: Sequence[int]) -> int:
        return self.iget(var, index, [1] * len(index))

    def iget_n(self, var: str, starts: Sequence[Sequence[int]], counts: Sequence[Sequence[int] | None]) -> int:
        return self._post("r", var, [(list(s), list(c if c is not None else [1] * len(s)), None) for s, c in zip(starts, counts, strict=True)])

    def iput(
        self, var: str, values: DataFrame, start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None, imap: Sequence[int] | None = None, *, buffered: bool = False
    ) -> int:
        """Writes ``values`` (d0.., value), indexed from 0 within the box; with ``imap`` they are (place, value), by places of a buffer laid out by it."""
        if imap is not None:
            cells, m = grid(values.sparkSession, count), F.lit(0).cast("long")
            for i, step in enumerate(imap):
                m = m + F.col(f"d{i}") * step
            values = cells.withColumn("place", m).join(values, "place").drop("place")
        return self._post("w", var, [(list(start), list(count), list(stride) if stride else None)], values, buffered)

    def bput(self, var: str, values: DataFrame, start: Sequence[int], count: Sequence[int], stride: Sequence[int] | None = None, imap: Sequence[int] | None = None) -> int:
        """As :meth:`iput`, charged to the attached buffer."""
        return self.iput(var, values, start, count, stride, imap, buffered=True)

    def iput1(self, var: str, index: Sequence[int], value) -> int:
        """Writes one element."""
        spark = next(iter(self.dataset.data.values())).sparkSession
        cell = grid(spark, [1] * len(index)).withColumn("value", F.lit(value))
        return self.iput(var, cell, index, [1] * len(index))

    def iput_n(self, var: str, values: DataFrame, starts: Sequence[Sequence[int]], counts: Sequence[Sequence[int] | None], *, buffered: bool = False) -> int:
        """Writes ``values`` (place, value) to a list of boxes, whose buffers follow each other; of boxes that overlap the later counts."""
        full = [list(c if c is not None else [1] * len(s)) for s, c in zip(starts, counts, strict=True)]
        n, base, rows = len(starts[0]), 0, []
        for k, (s, c) in enumerate(zip(starts, full, strict=True)):
            if prod(c):
                rows.append((k, base, prod(c), *s, *c))
            base += prod(c)
        boxes = values.sparkSession.createDataFrame(rows, ", ".join(["k long, base long, size long", *[f"{x}{i} long" for x in "sc" for i in range(n)]]))
        cells = boxes.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
        index, rest = [], F.col("p")
        for i in reversed(range(n)):
            index.insert(0, (F.col(f"s{i}") + F.pmod(rest, F.col(f"c{i}"))).alias(f"d{i}"))
            rest = F.call_function("div", rest, F.col(f"c{i}"))
        placed = cells.select(*index, (F.col("base") + F.col("p")).alias("place"), "k").join(values, "place")
        newest = placed.groupBy(*[f"d{i}" for i in range(n)]).agg(F.max_by("value", F.struct("k", "place")).alias("value"))
        posted = self._post("w", var, [(list(s), c, None) for s, c in zip(starts, full, strict=True)], newest, buffered)
        self.pending[posted].placed = True
        return posted

    def bput_n(self, var: str, values: DataFrame, starts: Sequence[Sequence[int]], counts: Sequence[Sequence[int] | None]) -> int:
        return self.iput_n(var, values, starts, counts, buffered=True)

    def attach(self, size: int) -> None:
        if size <= 0:
            raise ArrayError("NC_EINVAL", "buffer size")
        if self.buffer is not None:
            raise ArrayError("NC_EPREVATTACHBUF")
        self.buffer = size

    def detach(self) -> None:
        if self.buffer is None:
            raise ArrayError("NC_ENULLABUF")
        if self.usage():
            raise ArrayError("NC_EPENDINGBPUT")
        self.buffer = None

    def usage(self) -> int:
        return sum(r.buffered for r in self.pending.values())

    def size(self) -> int:
        if self.buffer is None:
            raise ArrayError("NC_ENULLABUF")
        return self.buffer

    def count(self) -> int:
        return len(self.pending)

    def _take(self, ids: Sequence[int] | str) -> tuple[list[Request], dict[int, str]]:
        if isinstance(ids, str):
            wanted = [r.id for r in self.pending.values() if ids == ALL or r.rw == ("r" if ids == ALL_GETS else "w")]
        else:
            wanted = list(ids)
        status = {i: "NC_NOERR" if i in self.pending else "NC_EINVAL_REQUEST" for i in wanted}
        return [self.pending.pop(i) for i in wanted if i in self.pending], status

    def cancel(self, ids: Sequence[int] | str = ALL) -> dict[int, str]:
        return self._take(ids)[1]

    def wait(self, ids: Sequence[int] | str = ALL) -> tuple[DataFrame | None, dict[int, str]]:
        """Applies the writes, the later one counting where they meet, then returns all reads as (req_id, place, value) and each status."""
        s = self.dataset.schema
        if s.defining:
            raise ArrayError("NC_EINDEFINE")
        taken, status = self._take(ids)
        for r in [r for r in taken if r.unchecked]:
            try:
                self._check(r.rw, r.var, r.boxes)
            except ArrayError as e:
                status[r.id] = e.name
                taken.remove(r)
        for var in dict.fromkeys(r.var for r in taken if r.rw == "w"):
            n = len(s.var(var).dims)
            moved = None
            for r in (r for r in taken if r.rw == "w" and r.var == var):
                start, _, stride = r.boxes[0] if not r.placed else ([0] * n, None, None)
                step = stride or [1] * n
                at = r.values.select(*[(F.col(f"d{i}") * step[i] + start[i]).alias(f"d{i}") for i in range(n)], "value", F.lit(r.id).alias("seq"))
                moved = at if moved is None else moved.unionByName(at)
                for start, count, stride in r.boxes:
                    if s.is_record(var) and prod(count):
                        s.numrecs = max(s.numrecs, start[0] + (count[0] - 1) * (stride[0] if stride else 1) + 1)
            self.dataset.data[var] = put(self.dataset.data[var], moved, n)
        out = None
        for r in (r for r in taken if r.rw == "r"):
            v = self.dataset.data[r.var]
            n = len(s.var(r.var).dims)
            if len(r.boxes) == 1:
                start, count, stride = r.boxes[0]
                got = vars_(v, start, count, stride)
                place = F.lit(0).cast("long")
                for i in range(n):
                    place = place * count[i] + F.col(f"d{i}") if r.imap is None else place + F.col(f"d{i}") * r.imap[i]
                got = got.select(place.alias("place"), "value")
            else:
                sizes = [prod(c) for _, c, _ in r.boxes]
                base = F.element_at(F.array(*[F.lit(sum(sizes[:j])).cast("long") for j in range(len(sizes))]), F.col("seq").cast("int") + 1)
                got = varn(v, [b[0] for b in r.boxes], [b[1] for b in r.boxes]).select((base + F.col("place")).alias("place"), "value")
            got = got.select(F.lit(r.id).cast("long").alias("req_id"), "place", F.col("value").cast("string" if s.var(r.var).kind == "char" else "double").alias("value"))
            out = got if out is None else out.unionByName(got)
        return out, status


def record_requests(requests: DataFrame) -> DataFrame:
    """Requests on records (req_id, s0, c0, ..) as one for each record."""
    one = requests.filter("c0 > 0").withColumn("_r", F.explode(F.sequence(F.col("s0"), F.col("s0") + F.col("c0") - 1)))
    return one.withColumns({"s0": F.col("_r"), "c0": F.lit(1).cast("long")}).drop("_r")


