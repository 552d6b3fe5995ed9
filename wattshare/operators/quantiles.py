"""Exact quantiles of any number of groups by selection: refined histograms, no group gathered or sorted.

A quantile is the value at a known rank.  Each round puts the values still in question into buckets whose borders a
mergeable sketch proposes, counts them exactly, and keeps the bucket that holds the rank.  A bucket holds a few
hundredths of its round's values, so rounds grow with the logarithm of the largest group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshare.session import staged

#: Borders of a round, and the sketch's accuracy.
BORDERS, ACCURACY = 63, 2_000


def exact_quantiles(
    df: DataFrame, by: Sequence[str], column: str, shares: Sequence[float], borders: int = BORDERS, accuracy: int = ACCURACY,
) -> DataFrame:
    """``by, share, value``: the smallest value with at least that share of the group's known values up to it.

    A group without known values has null; NaN counts as the greatest value.  ``df`` is read twice a round (borders, counts); pass
    a stored table.  Rounds end when every bracket holds one value; only whether any is open reaches the driver.
    """
    by = list(by)
    keys = [f"_k{i}" for i in range(len(by))]
    values = df.select(*by, F.col(column).cast("double").alias("_v"))

    def met(brackets: DataFrame) -> DataFrame:
        """Values with the brackets of their group that hold them: few of them, one per share at most."""
        same = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]
        return values.join(brackets, [*same, F.col("_v").between(F.col("_lo"), F.col("_hi"))])

    found = values.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)]).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    # A product such as 0.07 * 100 lies a little over the whole number that it means.
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("share") * F.col("_n"), 6))).cast("bigint")
    keys_and_share = [*keys, "share"]
    state = staged(found.withColumn("share", wanted).withColumn("_rank", rank), "quantile-state")
    done = [state.filter(F.col("_n") == 0).select(*keys_and_share, F.lit(None).cast("double").alias("value"))]
    state = state.filter(F.col("_n") > 0).drop("_n")
    points = [(i + 1) / (borders + 1) for i in range(borders)]
    while True:
        done.append(state.filter(F.col("_lo") == F.col("_hi")).select(*keys_and_share, F.col("_lo").alias("value")))
        state = state.filter(F.col("_lo") != F.col("_hi"))
        if state.isEmpty():
            break
        # The state itself is one of the grouped columns: the borders come beside it without another join.
        cut = staged(met(state).groupBy(*keys_and_share, "_rank", "_lo", "_hi").agg(
            F.array_distinct(F.percentile_approx("_v", points, accuracy)).alias("_cuts")), "quantile-cuts")
        # Buckets: below the first border, at it, between it and the next, and so on.
        place = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
        buckets = met(cut).select(*keys_and_share, "_rank", place.alias("_bucket"), "_v").groupBy(
            *keys_and_share, "_rank", "_bucket").agg(
            F.count(F.lit(1)).alias("_count"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # At most twice as many rows as borders, and one.
        upto = Window.partitionBy(*keys_and_share).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = buckets.withColumn("_upto", F.sum("_count").over(upto))
        below = F.col("_upto") - F.col("_count")
        state = staged(summed.filter((below < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))).select(
            *keys_and_share, "_lo", "_hi", (F.col("_rank") - below).alias("_rank")), "quantile-state")
    return reduce(DataFrame.unionByName, done).withColumnsRenamed(dict(zip(keys, by)))
