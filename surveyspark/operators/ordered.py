"""Positions and neighbours in an ordered group, without one task holding a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 65536


def with_index(
    df: DataFrame, group: list[str], order: str, ties: list[str] | None = None, out: str = "idx", chunk: int = CHUNK
) -> DataFrame:
    """0-based position by an integer key.

    Keys are cut into ranges of ``chunk``; ranges are counted (partial aggregation), the counts are
    accumulated, and only rows of one range are ever sorted together.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / F.lit(chunk)))
    g = group or ["_all"]
    if not group:
        b = b.withColumn("_all", F.lit(0))
    run = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        b.groupBy(*g, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*g, "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"))
    )
    local = Window.partitionBy(*g, "_b").orderBy(order, *(ties or []))
    return (
        b.withColumn("_r", F.row_number().over(local) - 1)
        .join(offsets, [*g, "_b"])
        .withColumn(out, F.col("_off") + F.col("_r"))
        .drop("_b", "_r", "_off", "_all")
    )


def group_sizes(df: DataFrame, group: list[str], out: str = "n_group") -> DataFrame:
    return df.join(df.groupBy(*group).agg(F.count(F.lit(1)).alias(out)), group)


def neighbours(
    df: DataFrame,
    group: list[str],
    columns: dict[str, Callable[[WindowSpec], Column]],
    idx: str = "idx",
    before: int = 1,
    after: int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """Evaluate window expressions that look ``before`` rows back and ``after`` rows ahead.

    Rows carry a dense position, so chunks are full and the halo of a chunk is exactly the last
    ``before`` rows of the previous one and the first ``after`` rows of the next.
    """
    assert max(before, after) <= chunk
    c, off = F.floor(F.col(idx) / F.lit(chunk)), F.col(idx) % F.lit(chunk)
    copies = [F.struct(c.alias("c"), F.lit(True).alias("home"))]
    if before:
        copies.append(F.when(off >= chunk - before, F.struct((c + 1).alias("c"), F.lit(False).alias("home"))))
    if after:
        copies.append(F.when((off < after) & (c > 0), F.struct((c - 1).alias("c"), F.lit(False).alias("home"))))
    d = df.select("*", F.explode(F.array_compact(F.array(*copies))).alias("_k"))
    d = d.select(*df.columns, F.col("_k.c").alias("_c"), F.col("_k.home").alias("_home"))
    w = Window.partitionBy(*group, "_c").orderBy(idx)
    return d.select("*", *[f(w).alias(n) for n, f in columns.items()]).filter("_home").drop("_c", "_home")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], pivots: int = 255) -> DataFrame:
    """Exact linear-interpolated quantiles of an unbounded column: rows (p, quantile).

    Approximate quantiles only choose the cut points; values are counted per distinct value, ranges are
    accumulated, and the two neighbours of each rank are then read off exactly.
    """
    v = df.select(F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.lit((i + 1) / (pivots + 1)) for i in range(pivots)])
    cuts = v.agg(F.percentile_approx("v", grid, F.lit(10000))).scalar()
    total = v.agg(F.sum("n")).scalar()
    b = v.withColumn("_cuts", cuts).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("v")))).drop("_cuts")
    sizes = b.groupBy("_b").agg(F.sum("n").alias("_n"))
    run = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        b.withColumn("_cum", F.sum("n").over(inner))
        .join(F.broadcast(offs), "_b")  # at most pivots + 1 rows
        .select("v", "n", (F.col("_off") + F.col("_cum") - F.col("n")).alias("lo"), (F.col("_off") + F.col("_cum")).alias("hi"))
        .withColumn("_total", total)
    )
    p = F.explode(F.array(*[F.lit(float(x)) for x in probs]))
    r = ranked.select("*", p.alias("p")).withColumn("pos", F.col("p") * (F.col("_total") - 1))
    low, high = F.floor("pos"), F.ceil("pos")
    hit_lo = (low >= F.col("lo")) & (low < F.col("hi"))
    hit_hi = (high >= F.col("lo")) & (high < F.col("hi"))
    return (
        r.filter(hit_lo | hit_hi)
        .groupBy("p")
        .agg(
            F.max(F.when(hit_lo, F.col("v"))).alias("a"),
            F.max(F.when(hit_hi, F.col("v"))).alias("b"),
            F.first(F.col("pos") - low).alias("f"),
        )
        .select("p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("quantile"))
    )
