"""Exact order statistics of groups of any size: by counts of values, cumulated over ranges of values.

Rows are counted by value first, which combines before the shuffle, so a value that very many rows share is one row. The
values of a group are dealt to ranges at approximate quantiles; sums by range give each range its place, and within the one range that
holds the asked place values are cumulated one by one. Boundaries only even out the ranges; the result doesn't depend on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def select(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, n, and each place's value): places map a name to the rank, from 0 and under n, as a function of the number n of the
    group's values; nulls are no values, and a group without values is not there."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("__cuts"), F.sum("__n").alias("n"))
    dealt = counts.join(cuts, keys).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy(*keys, "__range", "n").agg(F.sum("__n").alias("__size")).withColumn("__start", before)
    asked = {name: place(F.col("n")) for name, place in places.items()}
    holds = [(F.col("__start") <= p) & (p < F.col("__start") + F.col("__size")) for p in asked.values()]
    wanted = ranges.where(_any(holds)).select(*keys, "__range", "__start")
    inside = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(wanted, [*keys, "__range"]).withColumn("__end", F.col("__start") + F.sum("__n").over(inside))
    here = lambda p: (F.col("__end") - F.col("__n") <= p) & (p < F.col("__end"))
    return placed.groupBy(*keys, "n").agg(*[F.max(F.when(here(p), F.col("__v"))).alias(name) for name, p in asked.items()])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out |= c
    return out


def upper_quantile(q: float) -> Callable[[Column], Column]:
    """The place floor(n * q), at most the last."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(q)))


def upper_median(n: Column) -> Column:
    return F.floor(n / 2)
