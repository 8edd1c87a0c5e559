"""Operator 7, packing: cut tokenised documents into near-equal windows by Karmarkar-Karp multiway differencing.

A document's full windows are cut off first; what remains of it, less than a window, waits in a pool. Whenever the pool
holds ``group_windows`` windows' worth, differencing deals its pieces to that many windows: every piece starts as a
partial partition, and the two partitions with the largest imbalance are merged so that the fullest window of one meets
the emptiest of the other, until one partition is left. The window count starts at the least possible and
rises while a window exceeds its capacity. Where documents may be cut, as here, differencing says which pieces share a window, and a window
over capacity gives its surplus to windows with room before the count rises. Without cuts the count rises by some 2 to 3 in 100 over
groups of 256 windows, which would be padding; with them there is none.

Each task packs the documents it reads, one group of bounded size after another: nothing is shuffled, memory is
bounded by one group and one text, and a lost task is simply run again with the same result. Within a task a group's
surplus goes on to the next group; what is left at a task's end goes into windows of falling powers of two, which
need no padding.

Defined cases: a null or empty text is a document of the end token alone; repeated rows are documents of their own; of equal imbalances, and of
pieces of one length, the first that came is taken first; an
empty table gives an empty table; columns other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

import heapq
import os
import re
import string
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import in_arrow

#: Words with the space before them, and line ends. They make up a text unless it has other white space, or runs of it.
_PARTS = re.compile(r" ?\S+|\n")
_STARTS = re.compile(r"(?= \S)")
#: Parts of words kept with their ids in each generation of a Python worker's cache, which outlives tasks, and the longest that are.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 48


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the indices of ``sizes`` in ``k`` parts of near-equal sums, fullest first.

    A partial partition lists its filled parts by falling sum; the parts not listed are empty.
    """
    if not sizes or k < 1:
        return [[] for _ in range(max(k, 0))]
    spread = lambda parts: parts[0][0] - (parts[-1][0] if len(parts) == k else 0)
    heap = [(-n if k > 1 else 0, i, [(n, [i])]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        clash = len(a) + len(b) - k  # so many filled parts meet filled ones
        if clash <= 0:
            merged = a + b
        else:
            merged = a[: len(a) - clash] + b[: len(b) - clash]
            tail = b[len(b) - clash :]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - clash :], reversed(tail), strict=True)]
        merged.sort(key=itemgetter(0), reverse=True)
        heapq.heappush(heap, (-spread(merged), serial, merged))
        serial += 1
    parts = [items for _, items in heap[0][2]]
    return parts + [[] for _ in range(k - len(parts))]


Piece = tuple[int, int, int]  # document within the task, start, length


def pack(pieces: list[Piece], capacity: int, cut: bool) -> list[list[Piece]]:
    """Windows of at most ``capacity``. Without ``cut``, no piece may exceed the capacity."""
    total = sum(p[2] for p in pieces)
    k = -(-total // capacity)
    while True:
        windows = [[pieces[i] for i in part] for part in difference([p[2] for p in pieces], k)]
        if all(sum(p[2] for p in w) <= capacity for w in windows):
            return windows
        if cut:
            return level(windows, capacity)
        k += max(1, k // 64)


def level(windows: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Moves what exceeds the capacity of a window, cut off if need be, to windows with room."""
    surplus: list[Piece] = []
    for w in windows:
        over = sum(p[2] for p in w) - capacity
        while over > 0:
            doc, start, n = w.pop()
            take = min(n, over)
            if n > take:
                w.append((doc, start, n - take))
            surplus.append((doc, start + n - take, take))
            over -= take
    for w in windows:
        room = capacity - sum(p[2] for p in w)
        while room > 0 and surplus:
            doc, start, n = surplus.pop()
            take = min(n, room)
            w.append((doc, start, take))
            if n > take:
                surplus.append((doc, start + take, n - take))
            room -= take
    while surplus:  # no room is left: the window count rises
        window, room = [], capacity
        while surplus and room:
            doc, start, n = surplus.pop()
            take = min(n, room)
            window.append((doc, start, take))
            if n > take:
                surplus.append((doc, start + take, n - take))
            room -= take
        windows.append(window)
    return windows


_encoders: dict[tuple[str, int], Callable[[str], bytes]] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Callable[[str], bytes]:
    """A function from a text to its ids, as little-endian unsigned 32-bit integers; one for each vocabulary, cache size and process.

    Byte-level BPE never merges over the start of a word with its leading space, over a line end between words, or over the place where
    letters or digits give way to punctuation. So such parts can be encoded one by one and kept;
    texts with other white space are cut only where a space precedes a word.
    """
    if (path, cache_words) not in _encoders:
        _encoders[path, cache_words] = _new_encoder(path, cache_words)
    return _encoders[path, cache_words]


def _new_encoder(path: str, cache_words: int) -> Callable[[str], bytes]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings within a text are ordinary text
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}  # the last generation: what recurs moves on from it, the rest is let go

    def learn(missing: set[str]) -> None:
        """Word and punctuation after it are encoded apart, for the same words recur with other marks."""
        halves, new = {}, set()
        for p in missing:
            if p in before:
                known[p] = before[p]
                continue
            stem = p.rstrip(string.punctuation)
            if len(stem) != len(p) and stem[-1:].isalnum():
                halves[p] = stem, p[len(stem) :]
                for h in halves[p]:
                    if h in before:
                        known[h] = before[h]
                    elif h not in known:
                        new.add(h)
            else:
                new.add(p)
        listed = list(new)
        if not listed and not halves:
            return
        for p, e in zip(listed, tokenizer.encode_batch_fast(listed, add_special_tokens=False), strict=True):
            known[p] = array("I", e.ids).tobytes()
        for p, (stem, tail) in halves.items():
            known[p] = known[stem] + known[tail]

    def encode(text: str) -> bytes:
        parts = _PARTS.findall(text)
        if "\n\n" in text or len("".join(parts)) != len(text):
            parts = _STARTS.split(text)
        ids = list(map(known.get, parts))
        if None in ids:
            if len(known) > cache_words:
                before.clear()
                before.update(known)
                known.clear()
                ids = [None] * len(parts)
            learn({p for p, x in zip(parts, ids, strict=True) if x is None})
            ids = list(map(known.__getitem__, parts))
            for p in parts:
                if len(p) > CACHE_CHARS:
                    known.pop(p, None)
        return b"".join(ids)

    return encode


class _Packer:
    """The pool and the output rows of one task."""

    def __init__(self, capacity: int, group_windows: int, first_sequence: int):
        self.capacity, self.goal, self.sequence = capacity, capacity * group_windows, first_sequence
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.pool: list[Piece] = []
        self.pooled = self.serial = 0
        self.rows: list[tuple] = []

    def put(self, window: list[Piece]) -> None:
        offset = 0
        for d, start, n in window:
            doc_id, ids = self.docs[d]
            self.rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.sequence, offset))
            offset += n
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        d, self.serial = self.serial, self.serial + 1
        self.docs[d] = (doc_id, ids)
        rest = len(ids) % self.capacity
        for start in range(0, len(ids) - rest, self.capacity):
            self.put([(d, start, self.capacity)])
        if rest:
            self.pool.append((d, len(ids) - rest, rest))
            self.pooled += rest
        else:
            del self.docs[d]
        if self.pooled >= self.goal:
            self.flush()

    def flush(self) -> None:
        """Packs as many full windows as the pool can fill."""
        excess = self.pooled % self.capacity
        left: list[Piece] = []
        while excess:
            d, start, n = self.pool.pop()
            take = min(n, excess)
            left.append((d, start + n - take, take))
            if n > take:
                self.pool.append((d, start, n - take))
            excess -= take
        for w in pack(self.pool, self.capacity, cut=True) if self.pool else []:
            self.put(w)
        self.pool, self.pooled = left, sum(p[2] for p in left)
        self.docs = {d: self.docs[d] for d in {p[0] for p in left}}

    def finish(self) -> None:
        self.flush()
        size = 1 << self.capacity.bit_length()
        while self.pool:
            size //= 2
            if self.pooled < size:
                continue
            window, room = [], size
            while room:
                d, start, n = self.pool.pop()
                take = min(n, room)
                window.append((d, start, take))
                if n > take:
                    self.pool.append((d, start + take, n - take))
                room -= take
            self.pooled -= size
            self.put(window)


_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_windows: int = 256, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row for each piece of a document: where it starts, its length and digest, and its place in a sequence.

    ``cache_words`` trades a Python worker's memory, some 200 bytes a word and generation, for time; rows do not depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, cache_words)
        packer = _Packer(capacity, group_windows, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(_FIELDS)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _FIELDS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.frombuffer(encode(text.as_py() or "") + end, "<u4"))
                if len(packer.rows) > 20_000:
                    yield out()
        packer.finish()
        yield out()

    schema = ", ".join(f"{n} long" for n in _FIELDS)
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, schema)
