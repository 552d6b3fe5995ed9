"""Count, mean and squared deviation as one value that merges: statistics of a whole from those of its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moments(column: str) -> Column:
    """Aggregate: struct (n, mean, m2) of the known values; combinable within tasks."""
    c = F.col(column).cast("double")
    return F.struct(
        F.count(c).alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias("m2"))


def merged(parts: Column) -> Column:
    """Moments of the union of an array of moments, merged pair by pair, so that no large sums cancel.

    The array is sorted first: the same parts give the same last digit in whatever order they were gathered.
    """
    empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s: Column, p: Column) -> Column:
        n, gap = s["n"] + p["n"], p["mean"] - s["mean"]
        return F.struct(
            n.alias("n"), (s["mean"] + gap * p["n"] / n).alias("mean"),
            (s["m2"] + p["m2"] + gap * gap * s["n"] * p["n"] / n).alias("m2"))
    return F.aggregate(F.filter(F.sort_array(parts), lambda p: p["n"] > 0), empty, add)


def mean_of(m: Column) -> Column:
    return F.when(m["n"] > 0, m["mean"])


def std_of(m: Column) -> Column:
    """Sample deviation; unknown for fewer than two values."""
    return F.when(m["n"] > 1, F.sqrt(m["m2"] / (m["n"] - 1)))
