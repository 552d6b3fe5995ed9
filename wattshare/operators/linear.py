"""Linear residual learner with least absolute deviations, one system per fold and entity, all fitted together.

Absolute error is minimised by reweighted least squares: each pass weighs a row by the inverse of its last absolute
error and solves the weighted normal equations.  Their sums (products of features, products with the target) combine within
tasks, so a pass is one aggregation over the rows whatever the number of entities and folds, and an entity
with a third of all rows is one partly aggregated key.  The small systems are solved by array expressions where they
lie; nothing but plans passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshare.session import staged

#: Share of the target's deviation below which an absolute error counts as that much; ridge in units of the mean diagonal.
FLOOR_SHARE, RIDGE = 1e-3, 1e-9


def solved(matrix: Column, size: int) -> Column:
    """Solution of a symmetric positive definite system given as rows ``[g_i0 .. g_in, b_i]``, by elimination.

    Row k is divided by its pivot and taken from all others, for each k in turn; definite systems need no
    exchange of rows.
    """
    def eliminate(rows: Column, k: Column) -> Column:
        pivot = F.get(rows, k)
        head = F.get(pivot, k)

        def step(row: Column, i: Column) -> Column:
            return F.when(i == k, F.transform(pivot, lambda x: x / head)).otherwise(
                F.zip_with(row, pivot, lambda x, p: x - F.get(row, k) / head * p))
        return F.transform(rows, step)

    places = F.sequence(F.lit(0), F.lit(size - 1))
    done = F.aggregate(places, matrix, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def _inputs(features: Sequence[str]) -> list[Column]:
    """1, then each feature in units of its deviation around its mean; unknown and constant features are 0."""
    out = [F.lit(1.0)]
    for i, name in enumerate(features):
        mean, spread = F.get("_means", F.lit(i)), F.get("_spreads", F.lit(i))
        known = F.when(spread > 0, (F.col(name).cast("double") - mean) / spread)
        out.append(F.coalesce(known, F.lit(0.0)))
    return out


def _value(inputs: Sequence[Column], weights: str = "_beta") -> Column:
    return reduce(lambda a, b: a + b, [F.get(weights, F.lit(i)) * x for i, x in enumerate(inputs)])


@dataclass
class LinearModel:
    """A row per scope: means and spreads of the features, ``_beta`` (intercept first), rows ``seen``, mean absolute error."""

    table: DataFrame
    features: list[str]
    scope: list[str]
    min_rows: int

    def predict(self, df: DataFrame, name: str = "correction") -> DataFrame:
        """Add the correction by one join; 0 where the scope is unknown or had too few rows."""
        scored = df.join(self.table.drop("mean_abs_error"), self.scope, "left")
        value = F.when(F.col("seen") >= self.min_rows, _value(_inputs(self.features)))
        return scored.select(*df.columns, F.coalesce(value, F.lit(0.0)).alias(name))

    def coefficients(self) -> DataFrame:
        """``scope, feature, coefficient`` in units of the feature; ``(intercept)`` is the value where all features are 0."""
        slopes = F.transform(F.sequence(F.lit(1), F.lit(len(self.features))), lambda i: F.when(
            F.get("_spreads", i - 1) > 0, F.get("_beta", i) / F.get("_spreads", i - 1)).otherwise(0.0))
        known = self.table.withColumn("_slopes", slopes if self.features else F.array().cast("array<double>"))
        at_zero = F.get("_beta", F.lit(0)) - F.aggregate(
            F.zip_with("_slopes", "_means", lambda b, m: b * F.coalesce(m, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        entries = F.concat(
            F.array(F.struct(F.lit("(intercept)").alias("feature"), at_zero.alias("coefficient"))),
            F.array(*[F.struct(F.lit(c).alias("feature"), F.get("_slopes", F.lit(i)).alias("coefficient"))
                      for i, c in enumerate(self.features)]) if self.features else F.array())
        return known.select(*self.scope, "seen", F.inline(entries))

    def importance(self) -> DataFrame:
        """``scope, feature, weight``: what one deviation of the feature moves, as a share of all features of the scope."""
        sizes = F.transform(F.slice("_beta", 2, max(1, len(self.features))), lambda b: F.abs(b))
        total = F.aggregate("_sizes", F.lit(0.0), lambda s, x: s + x)
        entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(
            F.col("_total") > 0, F.get("_sizes", F.lit(i)) / F.col("_total")).otherwise(0.0).alias("weight"))
            for i, c in enumerate(self.features)])
        return self.table.withColumn("_sizes", sizes).withColumn("_total", total).select(*self.scope, F.inline(entries))


@dataclass(frozen=True)
class LinearL1:
    """Learner: least absolute deviations over ``features``, for all scopes in a fixed number of jobs.

    The first pass is plain least squares, each further one reweighs it.  ``weight`` names a column that multiplies a
    row's error.  Unknown values of a feature count as its mean.  Rows without target, or with an unknown or
    negative weight, are left out.  Features the rows lack are left out, so one list serves with and without weather.
    """

    features: Sequence[str]
    passes: int = 6
    weight: str | None = None
    min_rows: int = 500
    stage: bool = True

    def fit(self, train: DataFrame, target: str, scope: Sequence[str]) -> LinearModel:
        if self.passes < 1:
            raise ValueError("at least one pass")
        scope, features = list(scope), [c for c in self.features if c in train.columns]
        gain = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = train.select(*scope, *features, F.col(target).cast("double").alias("_y"), gain.alias("_gain")).filter(
            F.col("_y").isNotNull() & (F.col("_gain") >= 0))
        if self.stage:
            rows = staged(rows, "linear-rows")
        moments = rows.groupBy(*scope).agg(
            F.array(*[F.avg(F.col(c).cast("double")) for c in features]).cast("array<double>").alias("_means"),
            F.array(*[F.stddev_pop(F.col(c).cast("double")) for c in features]).cast("array<double>").alias("_spreads"),
            F.stddev_pop("_y").alias("_deviation"), F.count(F.lit(1)).alias("seen"))
        moments = staged(moments, "linear-moments")
        size = len(features) + 1
        scaled = rows.join(moments, scope).select(
            *scope, "_y", "_gain", "_deviation", *[x.alias(f"_x{i}") for i, x in enumerate(_inputs(features))])
        if self.stage:
            # Every pass reads plain numbers.
            scaled = staged(scaled, "linear-scaled")
        fitted = None
        for turn in range(self.passes):
            fitted = staged(_pass(scaled, fitted, size, scope), "linear-pass")
        return LinearModel(moments.drop("_deviation").join(fitted, scope), features, scope, self.min_rows)


def _pass(scaled: DataFrame, before: DataFrame | None, size: int, scope: list[str]) -> DataFrame:
    """``scope, _beta, mean_abs_error`` (of the coefficients before): one aggregation, and the systems it gives solved."""
    if before is None:
        weighed = scaled.withColumn("_error", F.lit(None).cast("double")).withColumn("_w", F.col("_gain"))
    else:
        # One narrow row per scope: broadcast or shuffled as its size asks.
        error = F.abs(F.col("_y") - _value([F.col(f"_x{i}") for i in range(size)]))
        floor = F.greatest(F.lit(FLOOR_SHARE) * F.col("_deviation"), F.lit(1e-12))
        weighed = scaled.join(before.drop("mean_abs_error"), scope).withColumn("_error", error).withColumn(
            "_w", F.col("_gain") / F.greatest("_error", floor))
    sums = {f"_g{i}_{j}": F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(size) for j in range(i + 1)}
    sums |= {f"_b{i}": F.sum(F.col("_w") * F.col(f"_x{i}") * F.col("_y")) for i in range(size)}
    totals = weighed.groupBy(*scope).agg(
        *[s.alias(name) for name, s in sums.items()], F.avg("_error").alias("mean_abs_error"))
    trace = reduce(lambda a, b: a + b, [F.col(f"_g{i}_{i}") for i in range(size)])
    ridge = F.greatest(F.lit(RIDGE / size) * trace, F.lit(1e-30))
    matrix = F.array(*[F.array(*[
        F.col(f"_g{max(i, j)}_{min(i, j)}") + (ridge if i == j else F.lit(0.0)) for j in range(size)], F.col(f"_b{i}"))
        for i in range(size)])
    return totals.select(*scope, solved(matrix, size).alias("_beta"), "mean_abs_error")
