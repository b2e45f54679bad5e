"""Running totals without one ordered task: totals of bins first, then totals inside each bin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A deterministic number in [0, 1) from the given values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def bin_count(rows: int) -> int:
    """About as many bins as rows in a bin, so neither one bin nor the list of bins is large for one task."""
    return max(1, math.isqrt(rows))


def running_total(df: DataFrame, parts: list[str], bins: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the earlier rows of the same `parts`, in the order (bins, order).

    The caller picks `bins` so that one bin holds a bounded number of rows.  Only one row per bin meets in
    a task that orders a whole part.  `parts` and `bins` must not be null."""
    sums = df.groupBy(*parts, *bins).agg(F.sum(value).alias("_bin_sum"))
    whole = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*parts, *bins, F.coalesce(F.sum("_bin_sum").over(whole), F.lit(0)).alias("_bin_start"))
    inside = Window.partitionBy(*parts, *bins).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*parts, *bins])
        .withColumn(out, F.col("_bin_start") + F.col("_inside"))
        .drop("_bin_start", "_inside")
    )
