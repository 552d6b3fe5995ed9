"""The training table: every leakage-safe feature beside the share it should explain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshare import features
from wattshare.functions.timegrid import DAY_SECONDS, days_later
from wattshare.operators.alpha import (
    attach_snapshot, check_lag_days, client_count_snapshot, cutoff_snapshot, robust_lag, same_dow_mean, trailing_stats, with_alpha,
    with_alpha_lags,
)
from wattshare.operators.baseline import training_rows, with_log_context
from wattshare.operators.calendar import with_calendar, with_daylight, with_fourier, with_week_bins
from wattshare.operators.holidays import with_holiday_context, with_holiday_flag
from wattshare.operators.panel import build_panel, build_panel_min, reclassify_large_clients
from wattshare.operators.weather import attach_weather, with_degree_days, with_temp_interactions
from wattshare.session import staged


def history_filter(df: DataFrame, min_days: int = 28, first_dates: DataFrame | None = None, label: str = "y") -> DataFrame:
    """Keep labelled rows at least ``min_days`` after their community's first date."""
    if first_dates is None:
        first_dates = first_date(df)
    aged = df.join(first_dates, "community_code").filter(
        F.datediff("target_date", "first_date") >= min_days)
    return aged.filter(F.col(label).isNotNull()).select(*df.columns)


def first_date(panel: DataFrame) -> DataFrame:
    """First local date per community: an aggregate, joined back small instead of a window over all rows."""
    return panel.groupBy("community_code").agg(F.min(F.to_date("datetime_local")).alias("first_date"))


def shares(
    readings: DataFrame, demand: DataFrame, full: bool = False, unique_readings: bool = False, stage: bool = False,
) -> DataFrame:
    """Panel with demand, share and local date; ``stage`` writes it once for the branches that follow."""
    panel = (build_panel if full else build_panel_min)(readings, unique_readings)
    out = with_alpha(panel, demand).withColumn("target_date", F.to_date("datetime_local"))
    return staged(out, "shares") if stage else out


def build_alpha_dataset(
    readings: DataFrame, demand: DataFrame, weather: DataFrame | None = None, holidays: DataFrame | None = None,
    cutoff_hour: int = 12, min_history_days: int = 28, lag_days: Sequence[int] = features.LAG_DAYS,
    unique_readings: bool = False, stage: bool = True, regional_holidays: bool = False, rolling: bool = False,
) -> DataFrame:
    """Readings to (X, y), one row per (community, slot).

    ``regional_holidays``: holidays carry a community and count there alone.  ``rolling`` adds ``ROLLING``: four-week
    statistics known two days before, and the mean of the same weekday's shares of four weeks.
    With ``stage`` the share table, thousands of times smaller than the readings, is written once to
    the shared folder; lags, snapshot and first dates read it there.  Without it each branch
    scans the readings again.
    """
    check_lag_days(lag_days)
    base = shares(readings, demand, unique_readings=unique_readings, stage=stage)
    rows = with_alpha_lags(base, lag_days)
    rows = attach_snapshot(rows, cutoff_snapshot(base, cutoff_hour))
    rows = history_filter(rows.withColumn("y", F.col("alpha")), min_history_days, first_date(base))
    rows = with_holiday_flag(attach_weather(rows, weather), holidays, regional=regional_holidays)
    rows = with_calendar(rows)
    if rolling:
        rows = rows.join(rolling_stats(base), ["community_code", "datetime_utc"], "left")
    lags = [f"alpha_lag_{n}d" for n in lag_days]
    wanted = [c for c in features.FEATURES if c not in features.LAGS and c in rows.columns]
    return rows.select(*features.BOOKKEEPING, "y", *lags, *wanted, *(features.ROLLING if rolling else []))


def rolling_stats(base: DataFrame) -> DataFrame:
    """Per (community, slot): share statistics of the 28 days up to two days before, and the same-weekday mean."""
    keys = ["community_code", "datetime_utc"]
    # 28 days and one second, so that the row exactly 28 days back belongs to the frame.
    span = 28 * DAY_SECONDS + 1
    past = trailing_stats(base.select(*keys, "alpha"), "alpha", {"roll_mean_28d": ("mean", span), "roll_std_28d": ("std", span)})
    known = past.select("community_code", days_later("datetime_utc", 2).alias("datetime_utc"), "roll_mean_28d", "roll_std_28d")
    own = same_dow_mean(base.select(*keys, "alpha"), "alpha", "same_dow_mean_28d", 28)
    return own.select(*keys, "same_dow_mean_28d").join(known, keys, "left")


def build_short_dataset(
    readings: DataFrame, demand: DataFrame, holidays: DataFrame | None = None, cutoff_hour: int = 12,
    min_history_days: int = 28, top_n: int = 10, fit_until: str | None = None, unique_readings: bool = False,
    stage: bool = True,
) -> DataFrame:
    """The reduced table: large clients apart, two lags, client count at the cutoff, no weather."""
    split = reclassify_large_clients(readings, top_n, fit_until)
    base = shares(split, demand, unique_readings=unique_readings, stage=stage)
    rows = with_alpha_lags(base, (2, 7))
    rows = attach_snapshot(rows, client_count_snapshot(base, cutoff_hour))
    rows = history_filter(rows.withColumn("y", F.col("alpha")), min_history_days, first_date(base))
    rows = with_calendar(with_holiday_flag(rows, holidays))
    return rows.select(*features.BOOKKEEPING, "y", *features.SHORT_FEATURES)


def rich_features(dataset: DataFrame) -> DataFrame:
    """Training rows with every derived feature: logs, yearly harmonics, week bins, daylight, holidays, temperature."""
    rows = with_log_context(training_rows(dataset))
    rows = with_daylight(with_week_bins(with_fourier(rows)))
    return with_holiday_context(with_temp_interactions(with_degree_days(rows)))


def compact_features(dataset: DataFrame) -> DataFrame:
    """Training rows with the small feature set: robust lag, one yearly harmonic, holiday context, degree days."""
    rows = with_log_context(training_rows(dataset))
    rows = robust_lag(rows, [f"alpha_lag_{n}d" for n in (7, 14, 21, 28)])
    rows = with_fourier(with_week_bins(rows), (1,))
    return with_holiday_context(with_degree_days(rows))
