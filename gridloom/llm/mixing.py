"""Operator 10, mixing sources to target weights, by weighted fair queueing.

Every source's documents are shuffled by a hash of their id and repeated up to ``max_epochs`` times. A copy's virtual
finish time is the words of its source up to its end, divided by the source's target. All copies, sorted by that
time over all sources, are taken until the budget of words is spent.

Neither the running sums nor the global sort put a source, an id, or all copies, into one task. Documents are sorted over all
partitions by source, hash and row; sums run within a partition, and from partition to partition over one row each. The sort needs no rows moved: words are summed over
ranges of the finish time, the one range in which the budget ends is cut finer, and only what remains there is
ordered; the last copy taken is one row, against which every document is then held.

Targets: the total of all sizes is shared by the sources' weights; a target stops at ``max_epochs`` times its
source's size, the excess goes to the others by weight, until none is above.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, ranked last; a null
id is a document like any other, with the hash of its row for that of its id; rows that repeat a ``doc_id`` are documents of their own,
in order of size and row hash; rows that are equal in all columns stand for each other; documents of one finish time follow in order of source, hash, id and copy; the result depends on the rows alone, not on their order or partitions; an empty table gives an empty table;
further columns are not read by the report and carried along by :func:`mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import discard, range_rank, settled, words

#: Ranges of finish time at each of the two levels. The first ends at time 2; what is later shares its last range.
RANGES = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, rank, target) of each source of ``sizes`` (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = range_rank(per, F.col("source").asc_nulls_last(), name="rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    per = settled(per.withColumn("w", weight.cast("long")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * max_epochs
    rest, share, capped = total, 0, -1
    above = F.lit(False)
    while True:  # each round caps at least one source more, or is the last; only sums come back
        row = per.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0)).alias("share"),
            F.count_if(above).alias("n"),
        ).first()
        rest, share = total - row["full"], row["share"]
        if row["n"] == capped or share == 0:
            break
        capped = row["n"]
        above = most.cast("double") * F.lit(float(share)) < F.lit(float(rest)) * F.col("w").cast("double")
    free = F.lit(float(rest)) * F.col("w").cast("double") / F.lit(float(max(share, 1)))
    return per.select("source", "source_size", "rank", F.when(above, most.cast("double")).otherwise(free).alias("target"))


def _row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of a whole row; columns that Spark cannot hash are left out."""
    every = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*every), F.xxhash64(F.lit(1), *every, F.lit(2))


def _queued(docs: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Every document with its source's figures and ``cum``, the words of its source up to its end."""
    h1, h2 = _row_hashes(docs)
    sized = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("size"), "source", h1.alias("h1"), h2.alias("h2"))
    sized = settled(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("h1").cast("string"))))))
    targets = source_targets(sized, weights, max_epochs).withColumnRenamed("source", "_source")
    # Ranges of the full order: no source and no id, however frequent, is one range.
    placed = sized.orderBy(F.col("source").asc_nulls_last(), "key", F.col("doc_id").asc_nulls_last(), "size", "h1", "h2").withColumn("at", F.monotonically_increasing_id())
    placed = settled(placed.withColumn("part", F.shiftright("at", 33)))
    discard(sized)
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition of the sort
    parts = parts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("source", "part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    running = placed.withColumn("run", F.sum("size").over(within))
    running = running.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    queued = running.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source", "source_size", "rank", "target", "key", "h1", "h2", (F.col("base") + F.col("run")).alias("cum")
    )
    queued = settled(queued)
    discard(placed)
    return queued


def _finish(epoch: Column | int) -> Column:
    """Virtual finish time of a document's copy."""
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.when(F.col("target") > 0, (e * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")).otherwise(F.lit(0.0))


def _place(epoch: Column | int) -> Column:
    """By which copies are sorted: the finish time, with ties broken for good."""
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.struct(
        _finish(epoch).alias("t"), F.col("rank").alias("r"), F.col("key").alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62)).alias("d"), e.cast("long").alias("e")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, ``copies``, how often the mix takes the document, and the hash of its row."""
    queued = _queued(docs, weights, max_epochs)
    budget = queued.agg(F.sum("size")).first()[0] or 0
    coarse = F.least(F.floor(F.col("t") * (RANGES // 2)), F.lit(RANGES - 1))
    fine = F.least(F.floor((F.col("t") * (RANGES // 2) - F.col("c")) * RANGES), F.lit(RANGES - 1))
    copies = queued.withColumn("e", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)]))).withColumn("t", _finish(F.col("e"))).withColumn("c", coarse)

    def end(rows: DataFrame, by: str, spent: int) -> tuple[int, int] | None:
        """The range in which the budget ends, and the words before it; at most RANGES rows are summed up."""
        ranges = rows.groupBy(by).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(W.orderBy(by).rowsBetween(W.unboundedPreceding, 0))
        row = ranges.withColumn("run", F.lit(spent) + run).filter(F.col("run") > budget).orderBy(by).first()
        return (row[by], row["run"] - row["words"]) if row else None

    last = sub = None
    if found := end(copies, "c", 0):
        inside = copies.filter(F.col("c") == found[0]).withColumn("f", fine)
        sub = end(inside, "f", found[1])
        if sub:
            order = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
            left = inside.filter(F.col("f") == sub[0]).select(_place(F.col("e")).alias("place"), "size")
            left = left.withColumn("run", F.lit(sub[1]) + F.sum("size").over(order))
            last = left.filter(F.col("run") <= budget).orderBy(F.col("place").desc()).select("place.*").first()
    taken = []
    for e in range(max_epochs):
        if found is None:
            inside_budget = F.lit(True)
        elif last is not None:
            mark = F.struct(F.lit(last["t"]).alias("t"), F.lit(last["r"]).alias("r"), F.lit(last["k"]).alias("k"), F.lit(last["d"]).alias("d"), F.lit(last["e"]).alias("e"))
            inside_budget = _place(e) <= mark
        else:  # the first copy of that range exceeds the budget already: what comes before the range is taken
            inside_budget = F.element_at(F.transform(F.array(F.struct(_finish(e).alias("x"))), lambda s: _before(s["x"], found[0], sub[0])), 1)
        taken.append(inside_budget.cast("int"))
    n = taken[0]
    for x in taken[1:]:
        n = n + x
    return queued.select("doc_id", "size", "source", "source_size", "target", "h1", "h2", n.alias("copies"))


def _before(x: Column, c: int, f: int) -> Column:
    at = F.least(F.floor(x * (RANGES // 2)), F.lit(RANGES - 1))
    return (at < c) | ((at == c) & (F.least(F.floor((x * (RANGES // 2) - at) * RANGES), F.lit(RANGES - 1)) < f))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document."""
    return mixed(docs, **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture: the rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows that are equal in all columns are one here, with the copies of all of them: they are thinned before anything moves.
    """
    h1, h2 = _row_hashes(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), h1.alias("_h1"), h2.alias("_h2"))
    rows = rows.withColumn("_turn", F.row_number().over(W.partitionBy("_h1", "_h2").orderBy("_h1"))).filter("_turn = 1")
    counts = mixed(docs, **how).groupBy("h1", "h2").agg(F.sum("copies").alias("copies")).filter(F.col("copies") > 0)
    out = rows.join(counts, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
