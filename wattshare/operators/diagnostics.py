"""Error reports over out-of-fold predictions.

Input rows carry ``community_code, datetime_utc, total_kw, baseline_kw, pred_kw`` and, where used, ``fold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshare.functions.rowwise import percent_gain
from wattshare.operators.baseline import portfolio

TOTALS = {"actual": "total_kw", "baseline": "baseline_kw", "pred": "pred_kw"}


def _gap(a: str, b: str):
    return F.abs(F.col(a) - F.col(b))


def _errors(actual: str, baseline: str, pred: str) -> list:
    return [F.avg(_gap(baseline, actual)).alias("mae_base"), F.avg(_gap(pred, actual)).alias("mae_model")]


def _with_lift(df: DataFrame) -> DataFrame:
    return df.withColumn("lift_pct", percent_gain("mae_base", "mae_model"))


def mae(df: DataFrame, by: Sequence[str] = (), at: Sequence[str] = ("datetime_utc",)) -> DataFrame:
    """Mean absolute error of the portfolio total, with the gain over the baseline.

    Entities are summed per stamp first: errors of different entities may cancel.
    """
    slots = portfolio(df, TOTALS, [*by, *at])
    report = slots.groupBy(*by).agg(*_errors("actual", "baseline", "pred"), F.count(F.lit(1)).alias("n_points"))
    return _with_lift(report.withColumn("gain_kw", F.col("mae_base") - F.col("mae_model")))


def lift_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row-level error per group, before any summing over entities."""
    return _with_lift(df.groupBy(*by).agg(
        *_errors("total_kw", "baseline_kw", "pred_kw"), F.count(F.lit(1)).alias("n")))


def lift_pivot(df: DataFrame, folds: Sequence[int]) -> DataFrame:
    """Lift per community, one column per fold."""
    per_fold = lift_by(df, ["community_code", "fold"])
    wide = per_fold.groupBy("community_code").pivot("fold", list(folds)).agg(F.first("lift_pct"))
    return wide.select("community_code", *[F.col(str(f)).alias(f"fold_{f}") for f in folds])


def daily_error(df: DataFrame) -> DataFrame:
    """Absolute error of each UTC day's total energy."""
    days = portfolio(df.withColumn("date", F.to_date("datetime_utc")), TOTALS, ["date"])
    out = days.withColumns({"err_model": _gap("pred", "actual"), "err_base": _gap("baseline", "actual")})
    return out.withColumn("lift_pct", percent_gain("err_base", "err_model"))


def worst_days(df: DataFrame, n: int = 15) -> DataFrame:
    return daily_error(df).orderBy(F.desc("err_model"), "date").limit(n)


def holiday_error(df: DataFrame, daily_flags: DataFrame) -> DataFrame:
    """Row-level error on holidays and on other days; ``daily_flags`` holds (target_date, is_holiday)."""
    listed = daily_flags.groupBy(F.col("target_date").alias("_date")).agg(F.max("is_holiday").alias("_hol"))
    flagged = df.join(listed, F.to_date("datetime_utc") == F.col("_date"), "left").withColumn(
        "is_hol", F.coalesce("_hol", F.lit(0)))
    return lift_by(flagged, ["is_hol"])


def cell_error(df: DataFrame) -> DataFrame:
    """Row-level error per weekday (Monday = 0) and UTC hour."""
    cells = df.withColumns({"dow": F.weekday("datetime_utc"), "hour": F.hour("datetime_utc")})
    return lift_by(cells, ["dow", "hour"])


def cell_matrix(df: DataFrame, value: str = "lift_pct") -> DataFrame:
    """Weekdays down, hours across."""
    wide = cell_error(df).groupBy("dow").pivot("hour", list(range(24))).agg(F.first(value))
    return wide.select("dow", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def worst_cells(df: DataFrame, n: int = 20) -> DataFrame:
    return cell_error(df).filter(F.col("lift_pct").isNotNull()).orderBy("lift_pct", "dow", "hour").limit(n)


def date_list_error(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Portfolio error per day, for chosen days."""
    wanted = [F.lit(d).cast("date") for d in dates]
    rows = df.withColumn("date", F.to_date("datetime_utc")).filter(F.col("date").isin(wanted))
    return mae(rows, by=["date"])


def week_error(df: DataFrame, starts: Sequence[str], days: int = 7) -> DataFrame:
    """Portfolio error over ``days`` days from each start, both ends included."""
    t, span = F.col("datetime_utc"), F.expr(f"INTERVAL '{int(days)}' DAY")
    listed = F.array(*[F.lit(s).cast("timestamp_ntz") for s in starts])
    own = F.filter(listed, lambda s: (t >= s) & (t <= s + span))
    weeks = df.withColumn("week_start", F.explode(own))
    return mae(weeks, by=["week_start"])


def seasonal_mae(df: DataFrame, months: Sequence[int] = (12, 1, 2)) -> DataFrame:
    """Baseline error of the portfolio in chosen months."""
    season = df.filter(F.month("datetime_utc").isin(list(months)))
    slots = portfolio(season, {"actual": "total_kw", "baseline": "baseline_kw"})
    return slots.agg(F.count(F.lit(1)).alias("n_points"), F.avg(_gap("baseline", "actual")).alias("mae_base"))


def compare_seasonal(plain: DataFrame, split: DataFrame, months: Sequence[int] = (12, 1, 2)) -> DataFrame:
    """Seasonal baseline error without and with large clients set apart, side by side."""
    labelled = [seasonal_mae(df, months).withColumn("variant", F.lit(name))
                for name, df in (("communities", plain), ("large_clients_apart", split))]
    return labelled[0].unionByName(labelled[1])


def correlations(df: DataFrame, columns: Sequence[str], label: str = "y") -> DataFrame:
    """Correlation of each column with the label over all rows, in one pass, strongest first."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "corr").orderBy(F.desc_nulls_last("corr"), "feature")


def association_importance(
    df: DataFrame, columns: Sequence[str], label: str, by: Sequence[str] = ("community_code",),
) -> DataFrame:
    """``by, feature, weight``: size of each column's correlation with the label in every group, in one pass.

    Rows count where both are known; a column or label without spread has weight 0.
    """
    def size_of(c):
        x = F.when(F.col(label).isNotNull(), F.col(c).cast("double"))
        y = F.when(F.col(c).isNotNull(), F.col(label).cast("double"))
        found = F.abs(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
        return F.coalesce(found, F.lit(0.0)).alias(c)
    return df.groupBy(*by).agg(*[size_of(c) for c in columns]).unpivot(list(by), list(columns), "feature", "weight")


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence, k: int, spread: str | None = None, parts: int = 64,
) -> DataFrame:
    """The first ``k`` rows of every group.

    With ``spread``, a key that is unique within a group, rows are ranked within ``parts`` hash parts of a group first, so
    that no task sees a whole group and the second ranking gets at most ``parts * k`` rows of it.
    """
    if spread is not None:
        first = Window.partitionBy(*by, F.pmod(F.xxhash64(spread), F.lit(parts))).orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
