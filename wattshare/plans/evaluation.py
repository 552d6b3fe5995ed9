"""Scoring and walk-forward validation of the whole forecast."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wattshare.operators.alpha import with_alpha
from wattshare.operators.baseline import (
    from_residual, portfolio_forecast, training_rows, with_baseline, with_baseline_d2, with_residual,
)
from wattshare.operators.calendar import with_calendar
from wattshare.operators.diagnostics import top_per_group
from wattshare.operators.linear import LinearL1
from wattshare.operators.model import Boosted, CellMedian
from wattshare.operators.panel import BROADCAST_ROWS, PROMOTED_PREFIX, build_panel_min, reclassify_large_clients
from wattshare.operators.validation import assign_folds, day_folds, fold_bounds
from wattshare.operators.weather import attach_weather
from wattshare.schemas import WEATHER_MEASURES_D2
from wattshare.session import staged


Learner = CellMedian | LinearL1 | Boosted

#: What a boosted learner may use in ``score`` and ``cross_validate``: baseline, cyclic calendar, issued weather.
SCORING_FEATURES = (
    "baseline_kw", "D_mw", "qhour", "dow", "month", "is_weekend", "sin_qhour", "cos_qhour", "sin_dow", "cos_dow", "sin_doy",
    "cos_doy", *WEATHER_MEASURES_D2,
)


def walk_forward(
    dataset: DataFrame, folds: Sequence[tuple[str, str, str]], pooled: bool = False, min_rows: int = 2000,
    bound: float | None = 0.5, learner: Learner | None = None, stage: bool = True, prepared: bool = False,
) -> DataFrame:
    """Out-of-fold predictions of the log ratio to the baseline.

    The learner defaults to cell medians, fitted for all folds in one pass; ``pooled`` fits one model per fold for all
    entities, otherwise one per fold and entity.  Train and validation rows are two reads of the rows, which ``stage``
    writes once; without it pass a stored table (``save_features``).  ``prepared`` rows carry baseline, target and
    further features already (``rich_features``, ``compact_features``).
    """
    rows = dataset if prepared else training_rows(dataset)
    rows = rows.filter(F.col("baseline_kw").isNotNull())
    rows = assign_folds(staged(rows, "walk-forward") if stage else rows, folds)
    scope = ["fold"] if pooled else ["fold", "community_code"]
    learner = learner or CellMedian(min_rows=min_rows, exact=not pooled)
    model = learner.fit(rows.filter(F.col("role") == "train"), "y_log", scope)
    valid = rows.filter(F.col("role") == "valid")
    scored = from_residual(model.predict(valid), "log", bound=bound)
    return scored.select("fold", "community_code", "datetime_utc", "target_date", "is_holiday",
                         "baseline_kw", "total_kw", "pred_kw")


def single_fold(
    dataset: DataFrame, train_end: str, valid_start: str, valid_end: str, kind: str = "kw", min_rows: int = 500,
    learner: Learner | None = None,
) -> DataFrame:
    """Predictions of one purged fold for a residual in kW or in share."""
    rows = with_residual(with_baseline(dataset.dropna(subset=["alpha_lag_7d"])), kind)
    rows = assign_folds(rows, [(train_end, valid_start, valid_end)])
    learner = learner or CellMedian(min_rows=min_rows)
    model = learner.fit(rows.filter(F.col("role") == "train"), "residual", ["community_code"])
    scored = from_residual(model.predict(rows.filter(F.col("role") == "valid")), kind)
    return scored.select("community_code", "datetime_utc", "target_date", "baseline_kw", "total_kw", "pred_kw")


def entity_rows(
    readings: DataFrame, demand: DataFrame, weather: DataFrame | None = None, top_n: int = 30,
    fit_until: str | None = None, unique_readings: bool = False, stage: bool = True,
) -> DataFrame:
    """Entities with their D-2 baseline, kW residual, issued weather and cyclic calendar; ``top_n`` 0 sets no client apart."""
    split = reclassify_large_clients(readings, top_n, fit_until) if top_n else readings
    panel = with_alpha(build_panel_min(split, unique_readings), demand)
    if stage:
        panel = staged(panel, "entities")
    rows = with_residual(with_baseline_d2(panel), "kw")
    return with_calendar(attach_weather(rows, weather, WEATHER_MEASURES_D2), "cyclic")


def score(
    readings: DataFrame, demand: DataFrame, start: str, end: str, weather: DataFrame | None = None,
    top_n: int = 30, min_rows: int = 500, unique_readings: bool = False, stage: bool = True,
    learner: Learner | None = None,
) -> DataFrame:
    """Forecast [start, end) from what precedes ``start``; returns (datetime_15min, prediction).

    The default learner looks at entity, weekday and slot alone; ``Boosted`` learns from the weather and calendar too
    (``SCORING_FEATURES``).  In the hour that the local clock repeats in autumn a stamp has two rows.  Large clients are
    ranked, and corrections fitted, on rows before ``start``; with ``top_n`` 0 none is set apart.  Entities are summed
    per UTC slot, so an hour repeated on the local clock is not added up.
    """
    rows = entity_rows(readings, demand, weather, top_n, fit_until=start, unique_readings=unique_readings, stage=stage)
    begin, stop = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    local = F.col("datetime_local")
    learner = learner or CellMedian(slot="qhour", min_rows=min_rows)
    model = learner.fit(rows.filter(local < begin), "residual", ["community_code"])
    scored = model.predict(rows.filter((local >= begin) & (local < stop)))
    total = portfolio_forecast(scored, ["datetime_utc", "datetime_local"])
    return total.select(F.col("datetime_local").alias("datetime_15min"), "prediction")


def _through(readings: DataFrame, day: date) -> DataFrame:
    """Readings up to the end of a local day, as a comparison that reaches the scan."""
    return readings.filter(F.col("datetime_local") < F.lit(day + timedelta(days=1)).cast("timestamp_ntz"))


def _by_fold(bounds: Sequence[Row], value, otherwise=None) -> Column:
    """``value(bounds of the row's fold)``: the few folds as one CASE expression."""
    chosen = F.lit(otherwise)
    for b in bounds:
        chosen = F.when(F.col("fold") == b.fold, value(b)).otherwise(chosen)
    return chosen


def _large_clients_per_fold(readings: DataFrame, bounds: Sequence[Row], top_n: int) -> DataFrame:
    """(client_id, in_folds): the folds in which a client ranks among the largest on train days.

    One sum per fold in a single pass: whatever the number of folds and days, a client is one row in the
    shuffle, and no more than ``top_n`` rows per task enter the ranking of a fold.
    """
    day = F.to_date("datetime_local")
    sums = [F.sum(F.when(day <= F.lit(b.train_end), F.col("active_kw"))).alias(f"_{b.fold}") for b in bounds]
    seen = _through(readings, max(b.train_end for b in bounds))
    totals = seen.groupBy("client_id").agg(*sums)
    per_fold = totals.select("client_id", F.explode(F.array(*[
        F.struct(F.lit(b.fold).alias("fold"), F.col(f"_{b.fold}").alias("kw")) for b in bounds])).alias("e"))
    ranked = top_per_group(
        per_fold.select("client_id", "e.*").filter(F.col("kw").isNotNull()), ["fold"],
        [F.desc("kw"), F.asc("client_id")], top_n, spread="client_id")
    return ranked.groupBy("client_id").agg(F.sort_array(F.collect_set("fold")).alias("in_folds"))


def _fold_entities(
    readings: DataFrame, large: DataFrame, bounds: Sequence[Row], unique_readings: bool = False,
) -> DataFrame:
    """Panel of every fold's own entities from one pass over the readings.

    Readings are reduced once to (community, slot, client if it is ever large).  What a large
    client is called differs between folds, so only that small table is repeated per fold, up to the
    fold's last validation day.
    """
    day = F.to_date("datetime_local")
    seen = _through(readings, max(b.valid_end for b in bounds))
    ever = large.select("client_id", F.col("client_id").alias("_large"))
    cell = seen.join(ever, "client_id", "left").groupBy("community_code", "datetime_utc", "_large").agg(
        F.min("datetime_local").alias("datetime_local"), F.sum("active_kw").alias("kw"),
        (F.count("client_id") if unique_readings else F.countDistinct("client_id")).alias("n"))
    apart = F.coalesce(F.array_contains("in_folds", F.col("fold")), F.lit(False))
    named = (
        cell.join(large.withColumnRenamed("client_id", "_large"), "_large", "left")
        .withColumn("fold", F.explode(F.array(*[F.lit(b.fold) for b in bounds])))
        .filter(day <= _by_fold(bounds, lambda b: F.lit(b.valid_end)))
        .withColumns({
            "apart": apart,
            "entity": F.when(apart, F.concat(F.lit(PROMOTED_PREFIX), F.col("_large"))).otherwise(F.col("community_code"))})
    )
    # A promoted client is one client even where it reads in several communities.
    clients = F.when(F.max("apart"), F.max("n")).otherwise(F.sum("n"))
    return named.groupBy("fold", F.col("entity").alias("community_code"), "datetime_utc").agg(
        F.min("datetime_local").alias("datetime_local"), F.sum("kw").alias("total_kw"), clients.alias("n_clients"))


def cross_validate(
    readings: DataFrame, demand: DataFrame, n_splits: int = 5, gap_days: int = 14, top_n: int = 30,
    min_rows: int = 500, unique_readings: bool = False, stage: bool = True, weather: DataFrame | None = None,
    learner: Learner | None = None,
) -> DataFrame:
    """Walk-forward report per fold: bounds, portfolio error in kW, points.

    Weather is joined as in ``score``, for learners that use it.

    Large clients and corrections are recomputed from each fold's train days.  The readings are read
    three times (days, ranking, panel), however many folds there are: ``fold`` is a column.  Of the folds
    only their bounds, at most ``n_splits`` rows, reach the driver; as constants they prune scans.
    """
    days = readings.select(F.to_date("datetime_local").alias("target_date"))
    folds = day_folds(days, n_splits, gap_days)
    bounds = fold_bounds(folds).orderBy("fold").collect()
    if not bounds:
        raise ValueError("too few days for one fold")
    large = _large_clients_per_fold(readings, bounds, top_n)
    if stage:
        large = staged(large, "large-clients")
    # At most n_splits × top_n rows, so the hint is bounded; beyond that Spark sizes the join.
    if n_splits * top_n <= BROADCAST_ROWS:
        large = F.broadcast(large)
    panel = with_alpha(_fold_entities(readings, large, bounds, unique_readings), demand)
    if stage:
        panel = staged(panel, "fold-entities")
    rows = with_residual(with_baseline_d2(panel, entity=("fold", "community_code")), "kw")
    day = F.to_date("datetime_local")
    rows = attach_weather(rows, weather, WEATHER_MEASURES_D2)
    placed = with_calendar(rows, "cyclic").withColumn("role", _by_fold(bounds, lambda b: F.when(
        day <= F.lit(b.train_end), "train").when(day.between(F.lit(b.valid_start), F.lit(b.valid_end)), "valid")))
    learner = learner or CellMedian(slot="qhour", min_rows=min_rows)
    model = learner.fit(placed.filter(F.col("role") == "train"), "residual", ["fold", "community_code"])
    scored = model.predict(placed.filter(F.col("role") == "valid"))
    slots = scored.withColumn(
        "pred_kw", F.coalesce("baseline_kw", F.lit(0.0)) + F.col("correction")
    ).groupBy("fold", "datetime_utc").agg(F.sum("total_kw").alias("actual"), F.sum("pred_kw").alias("pred"))
    edges = {name: _by_fold(bounds, lambda b, name=name: F.lit(b[name]))
             for name in ("train_start", "train_end", "valid_start", "valid_end")}
    report = slots.groupBy("fold").agg(
        F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae_kw"), F.count(F.lit(1)).alias("n_points"))
    return report.withColumns(edges).select("fold", *edges, "mae_kw", "n_points")
