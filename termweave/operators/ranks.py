"""Running totals and ranks over values, without one task that sorts them all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that a group is split into.
RANGES = 200


def ranged(df: DataFrame, by: Sequence[str], value: str, to: str = "_range", ranges: int = RANGES) -> DataFrame:
    """df with the number of the range that a value is in: ranges of about equal numbers of rows of each group, cut at
    approximate percentiles. Groups are features or classes, so that the cuts are small enough to broadcast."""
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), 20 * ranges).alias("_cuts"))
    placed = df.join(F.broadcast(cuts), list(by)) if by else df.join(F.broadcast(cuts))
    return placed.withColumn(to, F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")


def running(df: DataFrame, by: Sequence[str], value: str, sums: Mapping[str, str], totals: Mapping[str, str] | None = None, ranges: int = RANGES) -> DataFrame:
    """df with the running totals of some columns up to each value (rows of equal values included), and whole totals, by group.

    A window sums within ranges of values; what lies below a range comes from one row a range, joined by broadcast."""
    placed = ranged(df, by, value, ranges=ranges)
    parts = placed.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_of_{c}") for c in sums))
    up, whole = Window.partitionBy(*by).orderBy("_range"), Window.partitionBy(*by)
    below = {f"_below_{c}": F.sum(f"_of_{c}").over(up) - F.col(f"_of_{c}") for c in sums} | {to: F.sum(f"_of_{c}").over(whole) for c, to in (totals or {}).items()}
    offsets = parts.withColumns(below).drop(*(f"_of_{c}" for c in sums))
    within = Window.partitionBy(*by, "_range").orderBy(value)
    out = placed.withColumns({to: F.sum(c).over(within) for c, to in sums.items()}).join(F.broadcast(offsets), [*by, "_range"])
    return out.withColumns({to: F.col(to) + F.col(f"_below_{c}") for c, to in sums.items()}).drop("_range", *(f"_below_{c}" for c in sums))
