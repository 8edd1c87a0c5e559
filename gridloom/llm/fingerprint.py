"""Operator 3, document fingerprints: invertible Bloom lookup sketches of a text's paragraph digests.

A text is cut into paragraphs (lines, and the sentences of a line, so that a text without line breaks has parts too);
each gets a 64-bit digest, with its number of occurrence so far mixed in. A sketch is a row of cells, each with a count, a
sum of digests and a sum of their checks; every digest goes into three cells. Two sketches of one size subtract cell by
cell; what they share vanishes, and peeling cells that hold a single digest recovers those that differ. When
peeling sticks, both are built again four times larger. The likeness of two texts is the Jaccard coefficient of their digests,
as counted from the recovered difference.

Neighbours by ``doc_id`` meet without a global sort in one task: quantiles of the ids cut the rows into as many ranges
as there are shuffle partitions, texts move once to the task of their range, and the first document of a range also
goes to the range before. Within a task rows stream in id order; memory is bounded by a slice of documents.

Defined cases: a null or empty text has no paragraphs, and two such are alike by 1; rows with equal ids follow
each other by the hash of their text; a null id comes first; a table of one row is its own next; an empty table gives an
empty table; columns other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import in_arrow, partitions

#: Cells of the fingerprint that is returned, and by how much a retry is larger.
CELLS, GROWTH = 24, 4
#: Longer pieces are cut further, after words whose hash says so.
LONG_PIECE = 240
_PIECE = re.compile(r"[^\n.!?]+(?:[.!?]+(?=\s|$))?|[.!?]+")
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, different for each seed."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def pieces(text: str) -> list[str]:
    """The paragraphs of a text, without white space at their ends."""
    found = []
    for piece in _PIECE.findall(text):
        piece = piece.strip()
        if len(piece) <= LONG_PIECE:
            if piece:
                found.append(piece)
            continue
        run: list[str] = []
        for word in piece.split():
            run.append(word)
            if xxhash.xxh32_intdigest(word) % 8 == 0:
                found.append(" ".join(run))
                run = []
        if run:
            found.append(" ".join(run))
    return found


def digests(text: str) -> np.ndarray:
    seen: dict[str, int] = {}
    out = []
    for piece in pieces(text):
        n = seen[piece] = seen.get(piece, -1) + 1
        out.append((xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass")) + n * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    return np.unique(np.array(out, np.uint64))


class Sketches:
    """Sketches of many sets at once, set ``s`` in ``cells[s]`` cells; sets are told apart by ``owner``."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.cells)])
        size = int(self.first[-1])
        self.count = np.zeros(size, np.int64)
        self.keys = np.zeros(size, np.uint64)
        self.checks = np.zeros(size, np.uint64)

    def places(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Three cells of each key, one in each third of its sketch."""
        third = (self.cells[owner] // 3).astype(np.uint64)
        return np.stack([self.first[owner] + ((mix(keys, j) >> np.uint64(20)) % third + np.uint64(j) * third).astype(np.int64) for j in range(3)])

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> None:
        if not len(keys):
            return
        at = self.places(keys, owner).ravel()
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        signed = sign.astype(np.uint64)  # two's complement: -1 subtracts modulo 2**64
        np.add.at(self.count, at, np.tile(sign, 3))
        np.add.at(self.keys, at, np.tile(keys * signed, 3))
        np.add.at(self.checks, at, np.tile(mix(keys, 9) * signed, 3))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The digests found, their owners and signs, and for each set whether nothing was left over."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        owners = np.repeat(np.arange(len(self.cells)), self.cells)
        candidates = np.flatnonzero(np.abs(self.count) == 1)
        while len(candidates):
            sign = self.count[candidates]
            keys = self.keys[candidates] * sign.astype(np.uint64)
            pure = (np.abs(sign) == 1) & (mix(keys, 9) * sign.astype(np.uint64) == self.checks[candidates])
            keys, sign, owner = keys[pure], sign[pure], owners[candidates[pure]]
            if not len(keys):
                break
            _, one = np.unique(np.stack([keys, owner.astype(np.uint64)]), axis=1, return_index=True)
            keys, sign, owner = keys[one], sign[one], owner[one]
            found.append((keys, owner, sign))
            self.add(keys, owner, -sign)
            touched = np.unique(self.places(keys, owner))
            candidates = touched[np.abs(self.count[touched]) == 1]
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        clean = np.bincount(owners[left], minlength=len(self.cells)) == 0
        if not found:
            none = np.empty(0, np.int64)
            return none.astype(np.uint64), none, none, clean
        return *(np.concatenate(x) for x in zip(*found, strict=True)), clean


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def difference(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many digests only ``a[i]``, and only ``b[i]`` holds, by subtracting and peeling their sketches."""
    a, b = [np.unique(x) for x in a], [np.unique(x) for x in b]  # a digest that is there twice would never peel
    only_a, only_b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    sizes = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    cells = np.full(len(a), CELLS)
    while np.any(small := (cells < 1.5 * np.abs(sizes[0] - sizes[1])) & (cells < 1 << 40)):  # so much differs at least
        cells[small] *= GROWTH
    while len(todo):
        sketch = Sketches(cells[todo])
        sketch.add(*_flat([a[i] for i in todo]))
        sketch.add(*_flat([b[i] for i in todo]), -1)
        _, owner, sign, clean = sketch.peel()
        only_a[todo] = np.bincount(owner[sign > 0], minlength=len(todo))
        only_b[todo] = np.bincount(owner[sign < 0], minlength=len(todo))
        todo = todo[~clean]
        cells[todo] *= GROWTH
    return only_a, only_b


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard coefficients of the digest sets."""
    only_a, only_b = difference(a, b)
    both = np.array([len(x) for x in a]) - only_a
    every = both + only_a + only_b
    return np.where(every == 0, 1.0, both / np.maximum(every, 1))


def fingerprints(texts: list[str], sets: list[np.ndarray]) -> list[str]:
    """Each text's sketch as text: number of digests, a digest of the whole text, and the cells."""
    sketch = Sketches(np.full(len(sets), CELLS))
    sketch.add(*_flat(sets))
    cells = np.concatenate([sketch.count.reshape(-1, CELLS).astype("<i8").view("<u8"), sketch.keys.reshape(-1, CELLS), sketch.checks.reshape(-1, CELLS)], axis=1).astype("<u8")
    whole = [xxhash.xxh3_64_hexdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
    return [f"{len(s):x}.{w}.{base64.b64encode(c.tobytes()).decode()}" for s, w, c in zip(sets, whole, cells, strict=True)]


def ranges(docs: DataFrame, n: int) -> list[int]:
    """At most ``n`` ids that start ranges of about as many rows each, the least id first; n numbers reach the driver."""
    row = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [i / n for i in range(n)], 20_000).alias("cuts")).first()
    return sorted({row["least"], *row["cuts"]}) if row["least"] is not None else []


def neighbours(docs: DataFrame) -> DataFrame:
    """(_range, _guest, doc_id, text) by range and id; a guest is a range's end: the first of what follows."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = ranges(rows.select("doc_id"), n)
    if not cuts:
        return rows.select(F.lit(0).alias("_range"), F.lit(False).alias("_guest"), "doc_id", "text")
    # The last cut not above the id: first among every step-th cut, then among the step cuts from there.
    step = max(1, int(len(cuts) ** 0.5))
    starts, coarse = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(c) for c in cuts[::step]])
    reached = lambda among: F.greatest(F.size(F.filter(among, lambda c: c <= F.coalesce("doc_id", F.lit(cuts[0])))) - 1, F.lit(0))
    placed = rows.withColumn("_block", reached(coarse) * step)
    placed = placed.withColumn("_range", F.col("_block") + reached(F.slice(starts, F.col("_block") + 1, F.lit(step))))
    first = (F.get(starts, F.col("_range")) == F.col("doc_id")) | F.col("doc_id").isNull()
    before = F.pmod(F.col("_range") - 1, F.lit(len(cuts)))
    places = F.when(first, F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")), F.struct(before.alias("r"), F.lit(True).alias("g")))).otherwise(
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")))
    )
    spread = placed.withColumn("_p", F.explode(places)).select(F.col("_p.r").alias("_range"), F.col("_p.g").alias("_guest"), "doc_id", "text")
    return spread.repartitionById(n, F.col("_range")).sortWithinPartitions("_range", "_guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def fingerprint_report(docs: DataFrame, slice_rows: int = 256, slice_chars: int = 2_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document."""

    def judged(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """All rows but the last, which is the next of the one before."""
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        sets = [digests(t) for t in texts]
        edited = []
        for t, after in zip(texts, texts[1:], strict=False):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + after[:half])
        edited_sets = [digests(t) for t in edited]
        n = len(edited)
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        near = likeness(sets[:n] * 2, edited_sets + sets[1:])
        columns = [ids[:n], [len(t) for t in texts[:n]], sha, fingerprints(texts[:n], sets[:n]), fingerprints(edited, edited_sets), near[:n], near[n:]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        chars, current, ended = 0, None, False
        for b in batches:
            for r, guest, doc_id, text in zip(*(b.column(i) for i in range(4)), strict=True):
                r, text = r.as_py(), text.as_py()
                if r != current:
                    held, chars, current, ended = [], 0, r, False
                if ended:
                    continue
                held.append((doc_id.as_py(), text))
                chars += len(text)
                ended = guest.as_py()
                if len(held) > 1 and (ended or len(held) > slice_rows or chars > slice_chars):
                    yield judged(held)
                    held, chars = held[-1:], len(text)

    return in_arrow(neighbours(docs), run, _SCHEMA)
