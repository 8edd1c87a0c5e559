"""Operator 9, n-gram Jaccard join: grouped prefix join over word shingles, and the components of its links.

1. Equal shingle sets are one item, so that copies, however many, cost one row of a few numbers each. Sets are told apart by
   128 bits of hash; the 64 that name an item are replaced where two different sets have them in common.
2. Shingles are ordered by document frequency, rarest first; frequencies come from a sketch that counts
   all documents. Any fixed order gives right results; this one keeps what many documents share out of the prefixes.
3. Two sets of n and m shingles that are similar enough share ``k`` of their prefixes, of ``n - ceil(t n) + k`` shingles.
   Items with the same prefix and size are one group. Groups meet under each shingle of their prefixes; pairs that share
   fewer, or fail the filters on size and on first shared place, are left out.
4. What is left is expanded to members and verified on the full sets.

Groups are first held against one leader under each shingle, which joins most of what belongs together. Where groups of
different components still meet, they meet within bands of size. Up to ``direct`` items under one shingle and band form their
pairs. More of them never do: they are put in a bucket under a leader b, the item with the most links in the largest component
that meets there, so that many shingles give one bucket. Each item x is reduced to its difference d(x) to b, the elements that
one of both sets has alone. As x and y differ by ``|d(x)| + |d(y)| - 2 |d(x) & d(y)|`` elements,

* two items whose differences do not overlap link only if both link with the leader, which is checked for each item;
* all other links share an element in the first few of each difference, by rarity in the bucket: a prefix join again, over
  differences, in which what the bucket has in common no longer appears, nor what one component alone holds;
* under an element, pairs are formed with the items outside the component that holds it most often, or with those of which it is
  among the first, whichever are fewer; where either are more than ``direct``, the components are joined by the links found so
  far, and what still meets then gives the next buckets, with a new leader each.

After ``rounds`` of that all pairs that may still link are formed, so no link is lost; only the time of an input made for it would
grow there. What meets in a bucket moves as differences of a document's size and is joined by element, never gathered in a task.

Full sets are computed again for the candidates alone and never stored for all. Their ids are broadcast up to a
stated count; beyond it a Bloom filter of fixed size thins the documents, and a plain join does the rest.

Defined cases: a text with fewer words than a shingle has is one shingle as a whole; a null or empty text has none and
links with nothing; a null id links with nothing and has a null component; rows that repeat an id are rows of their
own; an empty table gives an empty table; columns other than ``doc_id`` and ``text`` are never read by the report.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import discard, in_arrow, settled
from gridloom.llm.graph import components


@dataclass(frozen=True)
class Settings:
    words: int = 3
    #: Two sets link when ``den * |both| >= num * |either|``.
    num: int = 90
    den: int = 100
    #: Counters of the frequency sketch and bits of the Bloom filter, as powers of two. Counters double with the input, up to 16 times.
    counter_bits: int = 20
    bloom_bits: int = 24
    #: Shingles that the prefixes of a pair must share.
    shared: int = 6
    #: Items under one shingle or element that form their pairs at once, and rounds of leaders for the rest.
    direct: int = 32
    rounds: int = 4
    #: Candidates' ids, 16 bytes each, are broadcast up to this many.
    broadcast_ids: int = 500_000


_BLOCK = 1 << 14  # counters in a row
#: Tasks of the frequency count at most; an input of more parts than that has a larger sketch.
_COUNT_TASKS = 4096
#: Copies of a leader's set, among which the members of its bucket are dealt.
_SALTS = 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, k: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = max(1, n - k + 1)
    x = np.full(m, min(n, k), np.uint64)
    for j in range(min(n, k)):
        x = (x ^ h[j : j + m]) * _M1
        x ^= x >> np.uint64(29)
    x *= _M2
    return np.unique(x ^ (x >> np.uint64(32)))


def prefix_length(n: int, s: Settings) -> int:
    return min(n, n - -(-s.num * n // s.den) + s.shared)


def frequencies(docs: DataFrame, s: Settings) -> np.ndarray:
    """Counts of shingles over all documents, in at least ``2 ** counter_bits`` counters; tasks send their sums in rows of a block."""
    texts = docs.select("text")
    more = max(0, texts._jdf.rdd().getNumPartitions() // _COUNT_TASKS).bit_length()
    bits = s.counter_bits + min(more, 4)
    size, shift = 1 << bits, np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        held, n = [], 0
        for b in batches:
            for t in b.column(0):
                x = shingles(t.as_py(), s.words)
                held.append(x)
                n += len(x)
                if n > 1 << 20:
                    total += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=size)
                    held, n = [], 0
        if held:
            total += np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=size)
        blocks = total.reshape(-1, min(_BLOCK, size))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in blocks], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(c.as_py(), "<i8")
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    parts = in_arrow(texts.coalesce(_COUNT_TASKS), count, schema)
    n = max(1, size // _BLOCK)
    rows = in_arrow(parts.repartitionById(min(n, 64), F.col("block") % min(n, 64)), add, schema).collect()  # 2 ** bits numbers
    out = np.zeros(size, np.int64)
    width = min(_BLOCK, size)
    for r in rows:
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["counts"], "<i8")
    return out


def prefixes(docs: DataFrame, s: Settings, carried: tuple[str, ...] = ()) -> DataFrame:
    """Settled: doc_id, n, sid (the set's name), s1 and s2 (its 128 bits), g1 and g2 (its prefix's and size's) and prefix of every document, then the long columns ``carried``."""
    counts = frequencies(docs, s)
    # Frequencies matter by their magnitude: an eighth of an octave to a step. A table of small numbers, one a counter.
    steps = docs.sparkSession.sparkContext.broadcast(np.round(8 * np.log2(np.maximum(counts, 1))).astype(np.uint16))
    shift = np.uint64(64 - (len(counts).bit_length() - 1))
    names = ["s1", "s2", "g1", "g2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = steps.value
        for b in batches:
            ns, keys, firsts = [], [], []
            for t in b.column(1):
                x = shingles(t.as_py(), s.words)
                rank = step[(x >> shift).astype(np.int64)]
                first = x[np.lexsort((x, rank))[: prefix_length(len(x), s)]]
                ns.append(len(x))
                keys.append(_name(x) + xxhash.xxh3_128_digest(first.tobytes(), len(x)))
                firsts.append(first.astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate(firsts) if firsts else [], pa.int64()))
            four = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 4)
            told = [pa.array(np.ascontiguousarray(four[:, k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *told, lists, *b.columns[2:]], ["doc_id", "n", *names, "prefix", *carried])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n long, s1 long, s2 long, g1 long, g2 long, prefix array<long>" + "".join(f", {c} long" for c in carried)
    rows = settled(in_arrow(docs.select("doc_id", "text", *carried), run, schema))
    # Different sets with the same first 64 bits: none is expected below some 10**9 documents, few beyond.
    clash = rows.groupBy("s1").agg(F.min("s2").alias("_lo"), F.max("s2").alias("_hi")).filter("_lo <> _hi").select(F.col("s1").alias("_s1"))
    if clash.isEmpty():
        return rows.withColumn("sid", F.col("s1"))
    return rows.join(clash, F.col("s1") == F.col("_s1"), "left").withColumn("sid", F.when(F.col("_s1").isNotNull(), F.xxhash64("s1", "s2")).otherwise(F.col("s1"))).drop("_s1")


def _name(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``2 ** bits`` bits over the column ``doc_id``, two bits a key; ``2 ** bits / 64`` numbers reach the driver."""
    at = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(j), "doc_id"), F.lit(1 << bits)) for j in (1, 2)])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask")).toPandas()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words.word.to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """Settled (sid, shingles) of the wanted (sid, doc_id, s1, s2): full sets, computed again from the documents that hold them."""
    if wanted.count() <= s.broadcast_ids:
        near = docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
        bloom = None
    else:
        near = docs.select("doc_id", "text")
        bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted, s.bloom_bits))
    hashed = near.select("text", *[F.pmod(F.xxhash64(F.lit(j), "doc_id"), F.lit(1 << s.bloom_bits)).alias(f"at{j}") for j in (1, 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for j in (1, 2) if bloom is not None else ():
                at = b.column(j).to_numpy()
                ok &= (bloom.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            found = np.flatnonzero(ok)
            for k in range(0, len(found), 256):
                sets = [shingles(b.column(0)[int(i)].as_py(), s.words) for i in found[k : k + 256]]
                two = np.frombuffer(b"".join(map(_name, sets)), np.int64).reshape(-1, 2)
                names = [pa.array(np.ascontiguousarray(two[:, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*names, pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["s1", "s2", "shingles"])

    found = in_arrow(hashed, run, "s1 long, s2 long, shingles binary")
    return settled(found.join(wanted.select("sid", "s1", "s2"), ["s1", "s2"]).select("sid", "shingles").dropDuplicates(["sid"]))


def _wanted(items: DataFrame, *sids: DataFrame) -> DataFrame:
    """Settled: the items named in any of the frames of one column."""
    named = sids[0].toDF("sid")
    for more in sids[1:]:
        named = named.unionByName(more.toDF("sid"))
    return settled(items.join(named.distinct(), "sid", "left_semi").select("sid", "doc_id", "s1", "s2"))


def _verify(docs: DataFrame, items: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Settled: those of the pairs (u, v) of items whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(s.den * common >= s.num * (len(x) + len(y) - common))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = settled(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct())
    wanted = _wanted(items, pairs.select("u"), pairs.select("v"))
    sets = _sets(docs, wanted, s)
    a = sets.select(F.col("sid").alias("u"), F.col("shingles").alias("x"))
    b = sets.select(F.col("sid").alias("v"), F.col("shingles").alias("y"))
    links = settled(in_arrow(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y"), run, "u long, v long"))
    discard(sets, wanted, pairs)
    return links


def _sizes_near(n: Column, m: Column, s: Settings) -> Column:
    return s.den * F.least(n, m) >= s.num * F.greatest(n, m)


def _places_near(n: Column, m: Column, i: Column, j: Column, count: Column, s: Settings) -> Column:
    """Whether sets that first meet at places i and j, and share ``count`` prefix shingles, can have enough in common."""
    need = F.ceil((s.num * (n + m)).cast("double") / float(s.num + s.den) - 1e-9)
    return (F.least(n - i, m - j) >= need) & (count >= F.least(F.lit(s.shared), need))


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _deltas(buckets: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Settled: every member x of a bucket b with its size n, difference to b, whether it links with b, and its component l, then b's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, near, deltas = [], [], []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                d = np.setxor1d(x, y, assume_unique=True)
                ns.append(len(x))
                near.append((s.den + s.num) * len(d) <= (s.den - s.num) * (len(x) + len(y)))
                deltas.append(d.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, deltas)]), pa.int32()), pa.array(np.concatenate(deltas) if deltas else [], pa.int64()))
            near = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pc.if_else(near, b.column(3), b.column(2)), pa.array(ns, pa.int64()), near, lists], ["b", "x", "l", "n", "near", "delta"])

    leaders = sets.join(buckets.select(F.col("b").alias("sid")).distinct(), "sid", "left_semi")
    leaders = leaders.select(F.col("sid").alias("b"), F.col("shingles").alias("bs"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    members = buckets.join(sets.select(F.col("sid").alias("x"), F.col("shingles").alias("xs")), "x").withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(_SALTS)).cast("int"))
    return settled(in_arrow(members.join(leaders, ["b", "salt"]).select("b", "x", "l", "lb", "xs", "bs"), run, "b long, x long, l long, n long, near boolean, delta array<long>"))


def _meet(deltas: DataFrame, s: Settings) -> DataFrame:
    """Settled: the first elements t of every difference, rarest in the bucket first; ``few`` for those that count for the smaller of two.

    Of two that link, differences of sizes p <= q share at least ``max(1, p - most / 2)`` and ``q - most`` elements, with ``most`` the largest number by
    which sets of their sizes may differ.
    """
    # Each element moves once for its count and once to come back to its difference.
    each = deltas.select("b", "x", "l", F.explode("delta").alias("t"))
    often = each.groupBy("b", "t").agg(F.count("*").alias("f"), F.min("l").alias("_lo"), F.max("l").alias("_hi")).filter("_lo <> _hi").select("b", "t", "f")
    shared = each.drop("l").join(often, ["b", "t"]).groupBy("b", "x").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))
    # Elements that one component alone holds come first in a difference; nothing meets there that has to be linked, only their number counts.
    most = _div(F.col("n") * (s.den - s.num), s.num)
    alone = F.size("delta") - F.size("o")
    own = deltas.join(shared, ["b", "x"]).select("b", "x", "l", "n", F.size("delta").alias("nd"), "o", alone.alias("alone"), (most + 1 - alone).alias("long"), (_div(most, 2) + 1 - alone).alias("short"))
    own = own.filter("long > 0").select("*", F.posexplode(F.slice("o", F.lit(1), F.col("long").cast("int"))).alias("i", "e"))
    # ``left``: how many elements it can share with one that it meets here for the first time.
    return settled(own.select("b", F.col("e.t").alias("t"), "x", "l", "n", "nd", (F.col("nd") - F.col("alone") - F.col("i")).alias("left"), (F.col("i") < F.col("short")).alias("few")))


def _close(pairs: DataFrame, deltas: DataFrame, s: Settings) -> DataFrame:
    """Settled: those of the pairs (u, v), both in bucket b, whose differences say that they link, with their components l1 and l2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                apart = len(np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
                keep.append((s.den + s.num) * apart <= (s.den - s.num) * (n + m))
            yield b.select(["u", "v", "l1", "l2"]).filter(pa.array(keep, pa.bool_()))

    one = deltas.select("b", F.col("x").alias("u"), F.col("n").alias("n1"), F.col("delta").alias("d1"), F.col("l").alias("l1"))
    two = deltas.select("b", F.col("x").alias("v"), F.col("n").alias("n2"), F.col("delta").alias("d2"), F.col("l").alias("l2"))
    both = pairs.join(one, ["b", "u"]).join(two, ["b", "v"]).select("u", "v", "n1", "n2", "d1", "d2", "l1", "l2")
    return settled(in_arrow(both, run, "u long, v long, l1 long, l2 long"))


def _dealt(rows: DataFrame, told: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with what is told of their key, or null; rows of one key are dealt by the column ``by`` over several tasks."""
    copies = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(_SALTS)).cast("int")).join(copies, [key, "salt"], "left").drop("salt")


def _after(told: DataFrame, close: DataFrame) -> DataFrame:
    """The next buckets (b, x, l, lb): what still meets in ``told`` under too many, with the components that the round's links have joined."""
    now = components(close.select(F.col("l1").alias("u"), F.col("l2").alias("v")), most_rounds=3)  # what is not joined yet only meets again
    changed = now.filter("node <> label")
    hot = told.filter("hot").select("b", "t", "x", "l", F.col("lead.x").alias("to"), F.col("lead.l").alias("lb"))
    for c in ("l", "lb"):
        hot = _dealt(hot, changed.select(F.col("node").alias(c), F.col("label").alias("_now")), c, "x").withColumn(c, F.coalesce("_now", c)).drop("_now")
    hot = settled(hot)
    discard(now)
    apart = hot.groupBy("b", "t").agg(F.min("l").alias("_lo"), F.max("l").alias("_hi")).filter("_lo <> _hi").select("b", "t")
    buckets = _merged(hot.join(apart, ["b", "t"], "left_semi").select(F.col("to").alias("b"), "x", "l", "lb"))
    discard(hot)
    return buckets


def _merged(buckets: DataFrame) -> DataFrame:
    """Settled: buckets (b, x, l, lb) with those of one component of leaders in one, under the leader of most of them."""
    first = buckets.groupBy("lb", "b").agg(F.count("*").alias("c")).groupBy("lb").agg(F.max(F.struct("c", "b"))["b"].alias("_b"))
    return settled(_dealt(buckets, first, "lb", "x").groupBy(F.col("_b").alias("b"), "x").agg(F.min("l").alias("l"), F.min("lb").alias("lb")))


def bucket_links(docs: DataFrame, items: DataFrame, buckets: DataFrame, s: Settings) -> DataFrame | None:
    """Verified links that span what the members of each bucket (b, x) have between components l; lb is b's."""
    buckets = _merged(buckets)
    links = None
    if buckets.isEmpty():
        return links
    wanted = _wanted(items, buckets.select("b"), buckets.select("x"))
    sets = _sets(docs, wanted, s)
    for turn in range(s.rounds):
        deltas = _deltas(buckets, sets, s)
        met = _meet(deltas, s)
        per = met.groupBy("b", "t", "l").agg(F.count_if("few").alias("p"), F.count("*").alias("q"), F.min(F.struct("nd", "x", "l")).alias("lead"))
        keys = per.groupBy("b", "t").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.count("*").alias("parts"), F.max(F.struct("q", "l")).alias("most"), F.min("lead").alias("lead"))
        # A missing link has an end outside the component that holds the element most often, and its smaller difference is one of the few.
        rest = F.col("q") - F.col("most.q")
        keys = keys.filter("parts > 1 and p > 0").withColumn("hot", (F.least("p", rest) > s.direct) & F.lit(turn < s.rounds - 1))
        keys = keys.select("b", "t", "hot", F.when(F.col("hot"), F.col("lead")).alias("lead"), F.when(rest < F.col("p"), F.col("most.l")).alias("held"))
        # Joined once: both sides of the pairs and the next buckets read it from here.
        told = settled(met.join(keys, ["b", "t"]))
        discard(met)
        cold = told.filter("not hot")
        one, two = (cold.select("b", "t", *[F.col(c).alias(f"{c}{k}") for c in ("x", "l", "n", "nd", "left", "few", "held")]) for k in (1, 2))
        one = one.filter(F.coalesce(F.col("l1") != F.col("held1"), "few1")).drop("held1")
        smaller = F.struct("nd1", "x1") < F.struct("nd2", "x2")
        # Each pair once, as its smaller end comes first or the other one is of the component that holds the element most often.
        once = (smaller & F.col("few1")) | (~smaller & F.col("few2") & F.coalesce(F.col("l2") == F.col("held2"), F.lit(False)))
        # As many elements must be shared, and so many can be.
        most = _div((F.col("n1") + F.col("n2")) * (s.den - s.num), s.den + s.num)
        able = once & (F.col("l1") != F.col("l2")) & (F.col("nd1") + F.col("nd2") - most <= 2 * F.least("left1", "left2"))
        pairs = one.join(two, ["b", "t"]).filter(able).groupBy(F.least("x1", "x2").alias("u"), F.greatest("x1", "x2").alias("v")).agg(F.min("b").alias("b"))
        close = _close(pairs, deltas, s)
        found = close.select("u", "v").unionByName(deltas.filter("near and b <> x").select(F.least("b", "x").alias("u"), F.greatest("b", "x").alias("v")))
        links = settled(found if links is None else links.unionByName(found))
        discard(buckets)
        buckets = None if told.filter("hot").isEmpty() else _after(told, close)
        discard(deltas, told, close)
        if buckets is None or buckets.isEmpty():
            break
    discard(sets, wanted, *[buckets] * (buckets is not None))
    return links


def _star(met: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """Groups against the leaders that they meet under several shingles, expanded to members against the leader's first."""
    pairs = met.filter("gid <> lead").groupBy("lead", "gid").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    sizes = members.filter("sid = gid").select(F.col("gid").alias("lead"), F.col("n").alias("m"))
    near = pairs.filter(F.col("c") >= F.least(F.lit(s.shared), F.col("n"))).join(sizes, "lead").filter(_sizes_near(F.col("n"), F.col("m"), s))
    return near.select(F.col("lead").alias("u"), "gid").join(members.select("gid", F.col("sid").alias("v")), "gid").select("u", "v")


def item_links(docs: DataFrame, rows: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Verified links (u, v) between items, enough of them to span every component."""
    # A group is named by its least item.
    named = items.groupBy("g1", "g2", "n").agg(F.min("sid").alias("gid"))
    members = settled(items.join(named, ["g1", "g2", "n"]).select("gid", "sid", "doc_id", "n"))
    heads = members.filter("sid = gid").select("gid", F.col("doc_id").alias("_doc"))
    holders = rows.join(heads, (F.col("sid") == F.col("gid")) & (F.col("doc_id") == F.col("_doc"))).select("gid", "n", "prefix").dropDuplicates(["gid"])
    tokens = settled(holders.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "token")))
    # Under a shingle that one group alone has in its prefix, nothing meets.
    heads_of = tokens.groupBy("token").agg(F.min("gid").alias("lead"), F.count("*").alias("c")).filter("c > 1")
    met = settled(tokens.join(heads_of.drop("c"), "token"))
    discard(tokens)
    links = _verify(docs, items, _star(met, members, s).unionByName(members.select(F.col("gid").alias("u"), F.col("sid").alias("v"))), s)
    label = components(links, most_rounds=3)  # what is not joined yet only leaves more to verify
    told = settled(members.join(label.withColumnRenamed("node", "sid"), "sid", "left").select("gid", "sid", F.coalesce("label", "sid").alias("label")))
    # The item with the most links stands for its component, and the largest component for those that meet.
    held = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("c"))
    centres = settled(label.join(held, "node").groupBy(F.col("label").alias("lb")).agg(F.count("*").alias("weight"), F.max(F.struct("c", "node"))["node"].alias("b")))
    discard(label, members)
    span = settled(told.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")))
    # Bands of size: sets that are near each other are in one band or in neighbours, and meet under the larger one's.
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(s.den / s.num) * 1.0001)).cast("int")
    spanned = met.join(span, "gid").select("token", "gid", "n", "i", "lo", "hi", "size", band.alias("own"))
    several = spanned.groupBy("token").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).filter("_lo <> _hi").select("token")
    banded = settled(spanned.join(several, "token").withColumn("band", F.explode(F.array("own", F.col("own") + 1))))
    places = banded.groupBy("token", "band").agg(F.sum("size").alias("c"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).filter("_lo <> _hi").drop("_lo", "_hi")
    left = settled(banded.join(places, ["token", "band"]))
    discard(met, banded)
    # Few under a shingle: pairs of groups.
    few = left.filter(F.col("c") <= s.direct)
    a = few.select("token", "band", F.col("own").alias("own1"), F.col("gid").alias("g"), F.col("n").alias("n1"), F.col("i").alias("i1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = few.select("token", "band", F.col("own").alias("own2"), F.col("gid").alias("h"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    apart = (F.col("lo1") != F.col("hi1")) | (F.col("lo2") != F.col("hi2")) | (F.col("lo1") != F.col("lo2"))
    here = F.greatest("own1", "own2") == F.col("band")
    under = a.join(b, ["token", "band"]).filter((F.col("g") < F.col("h")) & here & apart & _sizes_near(F.col("n1"), F.col("n2"), s))
    per = under.groupBy("g", "h").agg(F.count("*").alias("c"), F.min("i1").alias("i1"), F.min("i2").alias("i2"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    rest = per.filter(_places_near(F.col("n1"), F.col("n2"), F.col("i1"), F.col("i2"), F.col("c"), s)).select("g", "h")
    # Members of one group that its first member did not reach are held against each other in the same two ways.
    split = span.filter("lo <> hi")
    rest = rest.unionByName(split.filter(F.col("size") <= s.direct).select(F.col("gid").alias("g"), F.col("gid").alias("h")))
    one = told.select(F.col("gid").alias("g"), F.col("sid").alias("u"), F.col("label").alias("l1"))
    two = told.select(F.col("gid").alias("h"), F.col("sid").alias("v"), F.col("label").alias("l2"))
    links = links.unionByName(_verify(docs, items, rest.join(one, "g").join(two, "h").filter("l1 <> l2").select("u", "v"), s))
    # Many: buckets of items.
    hot = left.filter(F.col("c") > s.direct).select("token", "band", "gid", F.col("lo").alias("lb"))
    lead = _dealt(hot, centres.select("lb", "weight"), "lb", "gid").groupBy("token", "band").agg(F.max(F.struct(F.coalesce("weight", F.lit(1)).alias("weight"), "lb"))["lb"].alias("lb"))
    many = hot.drop("lb").join(lead, ["token", "band"]).select("gid", "lb")
    many = many.unionByName(split.filter(F.col("size") > s.direct).select("gid", F.col("lo").alias("lb"))).distinct()
    many = _dealt(many, centres.select("lb", "b"), "lb", "gid").join(told, "gid")
    more = bucket_links(docs, items, many.select(F.coalesce("b", "lb").alias("b"), F.col("sid").alias("x"), F.col("label").alias("l"), "lb"), s)
    discard(left, told, span, centres)
    return links if more is None else links.unionByName(more)


def _full(rows: DataFrame) -> DataFrame:
    """Those rows that can link with others."""
    return rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())


def _own(docs: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """sid, least doc_id and component's label of every item."""
    full = _full(rows)
    items = settled(full.groupBy("sid", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("g1").alias("g1"), F.first("g2").alias("g2")))
    label = components(item_links(docs, full, items, s))
    return settled(items.select("sid", "doc_id").join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid")))


def linked(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id, the least id that links reach, of every document."""
    rows = prefixes(docs, s)
    # The least id of each component, from the items' least ids; then every row by its item.
    own = _own(docs, rows, s)
    least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = own.join(least, "label").select(F.col("sid").alias("_sid"), "component_id")
    keyed = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("sid")).alias("_key"))
    # A set that a third of all rows share is one key of the larger side of this join, which Spark splits at run time.
    return keyed.join(named, F.col("_key") == F.col("_sid"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each component, that of the least id and then the least hash of its text.

    Rows that repeat an id are judged each by its own text. Texts without shingles stay, once for an id; rows with a null id stay always.
    """
    told = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    rows = prefixes(told, s, ("hash",))
    own = _own(told, rows, s)
    firsts = _full(rows).groupBy("sid").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    first = own.select("sid", "label").join(firsts, "sid").groupBy("label").agg(F.min("first").alias("first")).select("first.*")
    bare = rows.filter((F.col("n") == 0) & F.col("doc_id").isNotNull()).select("doc_id", "hash").distinct()
    found = first.unionByName(bare).select(F.col("doc_id").alias("_keep"), F.col("hash").alias("_kept_hash"))
    row = F.struct(*[docs[c] for c in docs.columns])
    rest = F.xxhash64(F.lit(0), *[docs[c] for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind])
    packed = docs.select(row.alias("_row"), docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_hash"), rest.alias("_rest"))
    stay = packed.filter(F.col("_id").isNotNull()).join(found, (F.col("_id") == F.col("_keep")) & (F.col("_hash") == F.col("_kept_hash")))
    # Rows of one id and one text: any would do, and the other columns' hash makes it the same one in every run.
    once = stay.withColumn("_turn", F.row_number().over(W.partitionBy("_keep", "_kept_hash").orderBy("_rest"))).filter("_turn = 1")
    return once.select("_row").unionByName(packed.filter(F.col("_id").isNull()).select("_row")).select("_row.*")
