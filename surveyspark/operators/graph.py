"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star contraction: neighbours are re-hung on the smallest node seen.

    Minima are partial aggregates, so a hub costs one row per map task; the join back is an equi-join that
    adaptive execution splits when one hub dominates.
    """
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    side = both.filter(F.col("v") > F.col("u")) if large else both.filter(F.col("v") < F.col("u"))
    j = side.join(low, "u")
    out = j.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(low.select("u", F.col("m").alias("v")))
    out = out.filter("u <> v")
    return out if large else out.distinct()  # the small star follows and sorts repeats out


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component is the smallest node.

    Alternating large-star and small-star contraction: O(log n) rounds, each a few shuffles of the edge
    table, each round's result kept in the shared folder (by a checkpoint unless ``keep`` does it otherwise).
    """
    e = keep(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    def mark(d: DataFrame):
        return d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = mark(e)
    while True:  # ends: each contraction lowers the sum of labels or leaves the table as it is
        e = keep(_star(_star(e, True), False))
        now = mark(e)
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("u")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("u").alias("node"), F.col("u").alias("component"))
    )
