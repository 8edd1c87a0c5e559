"""Comparison of datasets: headers both ways, then every value of every common variable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.index import dims


def diff_values(a: DataFrame, b: DataFrame, ndims: int, keep_equal: bool = False) -> DataFrame:
    """(index, value_a, value_b, kind) where two variables differ; kind is ``changed``, ``only_a`` or ``only_b``.

    Values are compared as they are, so NaN equals NaN and a null equals a null.
    """
    keys = dims(ndims)
    left = a.select(*keys, F.lit(0).alias("_at"), F.col("value").alias("value_a"), F.lit(True).alias("_a"))
    right = b.select(*keys, F.lit(0).alias("_at"), F.col("value").alias("value_b"), F.lit(True).alias("_b"))
    both = left.join(right, keys or ["_at"], "full_outer")
    kind = (
        F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~F.col("value_a").eqNullSafe(F.col("value_b")), "changed").otherwise("equal")
    )
    told = both.select(*keys, "value_a", "value_b", kind.alias("kind"))
    return told if keep_equal else told.filter("kind <> 'equal'")


def diff_summary(differences: DataFrame, by: str = "var") -> DataFrame:
    """Counts by kind for each variable."""
    return differences.groupBy(by).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("changed", "only_a", "only_b")])


def diff_schema(a, b) -> list[tuple[str, str, str]]:
    """(what, name, how) for each difference of two schemas: dimensions, attributes and variables, both ways."""
    found: list[tuple[str, str, str]] = []

    def both(what: str, x: dict, y: dict, same) -> None:
        for name in x.keys() - y.keys():
            found.append((what, name, "only_a"))
        for name in y.keys() - x.keys():
            found.append((what, name, "only_b"))
        for name in x.keys() & y.keys():
            if how := same(x[name], y[name]):
                found.append((what, name, how))

    both("dimension", {d.name: d for d in a.dims}, {d.name: d for d in b.dims}, lambda p, q: "size" if (p.size, p.unlimited) != (q.size, q.unlimited) else "")
    both("attribute", a.attrs, b.attrs, lambda p, q: "value" if p != q else "")

    def variable(p, q) -> str:
        if p.kind != q.kind:
            return "type"
        if len(p.dims) != len(q.dims):
            return "ndims"
        if a.shape(p.name) != b.shape(q.name):
            return "dimlen"
        return ""

    va, vb = {v.name: v for v in a.vars}, {v.name: v for v in b.vars}
    both("variable", va, vb, variable)
    for name in va.keys() & vb.keys():
        both(f"attribute of {name}", va[name].attrs, vb[name].attrs, lambda p, q: "value" if p != q else "")
    return sorted(found)
