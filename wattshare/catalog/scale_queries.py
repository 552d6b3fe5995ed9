"""Mechanisms for long histories and many entities: linear learners, client bitmaps, state, gaps, selection, stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshare.catalog.base import query
from wattshare.catalog.forecast_queries import _COMPACT_CAT, _COMPACT_NUM, _OOF_KEYS, _WITHIN, _bounded
from wattshare.catalog.shared import base, base_daily, dataset, panel
from wattshare.catalog.source_queries import SLOT, _scratch, feature_columns
from wattshare.catalog.sql import FOLDS, METER_MIN_ROWS
from wattshare.operators import alpha as A
from wattshare.operators import baseline as B
from wattshare.operators import diagnostics as D
from wattshare.operators import first_seen as S
from wattshare.operators import model as M
from wattshare.operators import quality as Q
from wattshare.operators.calendar import with_calendar
from wattshare.operators.linear import LinearL1
from wattshare.operators.panel import KEYS, client_blocks, client_numbers, distinct_clients
from wattshare.operators.quantiles import exact_quantiles
from wattshare.operators.validation import assign_fold_table, assign_folds, holdout
from wattshare.operators.weather import with_degree_days
from wattshare.plans.dataset import compact_features
from wattshare.plans.evaluation import walk_forward
from wattshare.session import staged
from wattshare.sources import tables
from wattshare.sources.fixtures import Daily, Meter

PANEL = (f"{SLOT}, datetime_local:t, n_clients:i, n_missing:i, n_new_clients:i, total_kw:f2, mean_kw:f6, median_kw:f2, "
         "std_kw:f6, min_kw:f2, max_kw:f2, n_reporting:i, avg_kw_per_client:f6, avg_kw_reporting:f6")

LEVELS = ["sn_alpha_last", "sn_alpha_mean_24h", "sn_alpha_mean_7d", "alpha_lag_mean"]
LINEAR = [*[f"rev_{c}" for c in LEVELS], "sin_mod", "cos_mod", "sin_dow", "cos_dow", "is_weekend", "hdd18", "cdd22", "is_holiday"]


# Linear learner


def _reweighted(source: str, passes: int, share: float = 1e-3) -> str:
    """Least absolute deviations of y on x per (fold, community_code): plain sums, then sums weighed by the last errors."""
    keys = "fold, community_code"
    steps = [f"d AS MATERIALIZED (SELECT {keys}, y, COALESCE(x, avg(x) OVER g) - avg(x) OVER g AS cx, avg(x) OVER g AS mx, "
             f"stddev_pop(y) OVER g AS dev FROM ({source}) WHERE y IS NOT NULL WINDOW g AS (PARTITION BY {keys}))"]
    for i in range(passes):
        weight = "1.0" if i == 0 else f"1.0 / greatest(abs(d.y - c.a - c.b * d.cx), {share!r} * d.dev)"
        rows = "d" if i == 0 else f"d JOIN c{i - 1} c USING ({keys})"
        steps.append(
            f"c{i} AS MATERIALIZED (SELECT {keys}, n, mx, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b, "
            f"(sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s AS a FROM (SELECT {keys}, count(*) AS n, min(mx) AS mx, sum(w) AS s, "
            f"sum(w * cx) AS sx, sum(w * cx * cx) AS sxx, sum(w * y) AS sy, sum(w * cx * y) AS sxy FROM (SELECT d.*, {weight} AS w "
            f"FROM {rows}) GROUP BY {keys}))")
    return f"WITH {', '.join(steps)} SELECT {keys}, a - b * mx AS intercept, b AS slope, n AS seen FROM c{passes - 1}"


@query("linear_coefficients_o25", "fold:i, community_code:s, intercept:f5, slope:f6, seen:i", "O25",
       _reweighted("SELECT fold, community_code, y_log AS y, temperature_2m AS x FROM placed WHERE role = 'train'", 4))
def _(spark, sf):
    """All entities and folds in one pass per reweighting, some temperatures unknown."""
    rows = B.training_rows(dataset(spark, sf)).filter(F.col("baseline_kw").isNotNull())
    train = assign_folds(rows, FOLDS).filter(F.col("role") == "train")
    model = LinearL1(["temperature_2m"], passes=4).fit(train, "y_log", ["fold", "community_code"])
    return model.coefficients().groupBy("fold", "community_code", "seen").agg(
        F.max(F.when(F.col("feature") == "(intercept)", F.col("coefficient"))).alias("intercept"),
        F.max(F.when(F.col("feature") == "temperature_2m", F.col("coefficient"))).alias("slope"))


@query("least_squares_o25", "fold:i, community_code:s, intercept:f6, slope:f6, seen:i", "O25",
       "SELECT fold, community_code, regr_intercept(y_log, baseline_kw) AS intercept, regr_slope(y_log, baseline_kw) AS slope, count(y_log) AS seen "
       "FROM placed WHERE role = 'train' GROUP BY 1, 2")
def _(spark, sf):
    """The first pass alone is plain least squares."""
    rows = B.training_rows(dataset(spark, sf)).filter(F.col("baseline_kw").isNotNull())
    train = assign_folds(rows, FOLDS).filter(F.col("role") == "train")
    model = LinearL1(["baseline_kw"], passes=1).fit(train, "y_log", ["fold", "community_code"])
    return model.coefficients().groupBy("fold", "community_code", "seen").agg(
        F.max(F.when(F.col("feature") == "(intercept)", F.col("coefficient"))).alias("intercept"),
        F.max(F.when(F.col("feature") == "baseline_kw", F.col("coefficient"))).alias("slope"))


def _linear_rows(spark, sf) -> DataFrame:
    return B.with_reversion(with_degree_days(B.training_rows(dataset(spark, sf))), LEVELS)


@query("linear_entity_o25", f"fold:i, {_WITHIN}", "O25 O23", _OOF_KEYS)
def _(spark, sf):
    """Twelve features, least absolute deviations, every fold."""
    return _bounded(walk_forward(_linear_rows(spark, sf), FOLDS, learner=LinearL1(LINEAR, min_rows=METER_MIN_ROWS), prepared=True))


@query("linear_pooled_o26", f"fold:i, {_WITHIN}", "O26 O23", _OOF_KEYS)
def _(spark, sf):
    learner = LinearL1(LINEAR, min_rows=METER_MIN_ROWS, weight="baseline_kw")
    return _bounded(walk_forward(_linear_rows(spark, sf), FOLDS, pooled=True, learner=learner, prepared=True))


FOLDS_D = [("1996-12-17", "1997-01-01", "1998-01-01"), ("1998-12-18", "1999-01-01", "2000-01-01"), ("2000-06-17", "2000-07-01", "2001-07-01")]


def daily_rows(spark, sf) -> DataFrame:
    """Daily portfolio with its lags, baseline of the week before, log residual and what a linear learner may use."""
    lags = {f"alpha_lag_{n}d": ("alpha", n) for n in (2, 7, 14, 21, 28)} | {"n_clients_d2": ("n_clients", 2)}
    rows = with_calendar(A.with_lags(base_daily(spark, sf), lags), "cyclic")
    rows = rows.withColumn("baseline_kw", F.col("alpha_lag_7d") * F.col("n_clients_d2") * F.col("D_mw")).filter(
        "baseline_kw IS NOT NULL AND total_kw IS NOT NULL")
    rows = B.with_reversion(rows, ["alpha_lag_2d", "alpha_lag_14d", "alpha_lag_21d", "alpha_lag_28d"])
    return B.with_residual(rows, "log", "y_log")


DAILY_LINEAR = [*[f"rev_alpha_lag_{n}d" for n in (2, 14, 21, 28)], "n_clients_d2", "is_holiday", "sin_dow", "cos_dow", "sin_doy", "cos_doy"]


@query("linear_beats_cells_o25", "fold:i, below_cells:i, below_baseline:i, n_rows:i", "O25 O23",
       "SELECT f.fold, 1 AS below_cells, 1 AS below_baseline, count(*) AS n_rows FROM (VALUES "
       + ", ".join(f"({i}, DATE '{a}', DATE '{b}')" for i, (_, a, b) in enumerate(FOLDS_D)) + ") f(fold, a, b) JOIN (SELECT b.target_date, "
       "l7.alpha * l2.n_clients * b.D_mw AS base, b.total_kw FROM base_d b JOIN base_d l7 ON l7.community_code = b.community_code AND "
       "l7.datetime_utc = b.datetime_utc - INTERVAL '7' DAY JOIN base_d l2 ON l2.community_code = b.community_code AND l2.datetime_utc = "
       "b.datetime_utc - INTERVAL '2' DAY) r ON r.target_date >= f.a AND r.target_date < f.b WHERE r.base IS NOT NULL AND r.total_kw IS NOT NULL "
       "GROUP BY 1")
def _(spark, sf):
    """Held-out absolute error of the learner that is meant to lower it, against cell medians and the bare baseline."""
    rows = assign_folds(staged(daily_rows(spark, sf), "daily"), FOLDS_D)
    train, valid = rows.filter(F.col("role") == "train"), rows.filter(F.col("role") == "valid")
    scope = ["fold", "community_code"]
    linear = LinearL1(DAILY_LINEAR, min_rows=METER_MIN_ROWS).fit(train, "y_log", scope)
    cells = M.CellMedian(slot="qhour", min_rows=METER_MIN_ROWS).fit(train, "y_log", scope)
    scored = cells.predict(linear.predict(valid, "_linear"), "_cells")
    errors = scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs("y_log")).alias("_base"),
        F.avg(F.abs(F.col("y_log") - F.col("_linear"))).alias("_l"), F.avg(F.abs(F.col("y_log") - F.col("_cells"))).alias("_c"))
    return errors.withColumns({
        "below_cells": (F.col("_l") < F.col("_c")).cast("int"), "below_baseline": (F.col("_l") < F.col("_base")).cast("int")})


@query("linear_importance_o31", "fold:i, community_code:s, features:i, weight_sum:f6, none_negative:i", "O31",
       f"SELECT DISTINCT fold, community_code, {len(LINEAR)} AS features, 1.0 AS weight_sum, 1 AS none_negative FROM placed WHERE role = 'train'")
def _(spark, sf):
    """Every fold and entity, from one fit."""
    rows = assign_folds(_linear_rows(spark, sf).filter(F.col("baseline_kw").isNotNull()), FOLDS)
    model = LinearL1(LINEAR).fit(rows.filter(F.col("role") == "train"), "y_log", ["fold", "community_code"])
    return model.importance().groupBy("fold", "community_code").agg(
        F.count(F.lit(1)).alias("features"), F.sum("weight").alias("weight_sum"), F.min((F.col("weight") >= 0).cast("int")).alias("none_negative"))


_ASSOCIATED = ["alpha_lag_7d", "alpha_lag_14d", "sn_alpha_mean_7d", "n_clients_at_cutoff", "D_mw", "hour", "dow", "temperature_2m", "sin_mod"]


@query("associated_features_o31_t5", "community_code:s, rank:i, feature:s, share:f6", "O31 T5 W11",
       "SELECT community_code, feature, rank, share FROM (SELECT community_code, feature, w / sum(w) OVER (PARTITION BY community_code) AS share, "
       "row_number() OVER (PARTITION BY community_code ORDER BY round(w, 9) DESC, feature) AS rank FROM (SELECT community_code, unnest("
       f"{_ASSOCIATED}) AS feature, unnest([" + ", ".join(f"COALESCE(abs(corr(CAST({c} AS DOUBLE), y_log)), 0.0)" for c in _ASSOCIATED)
       + "]) AS w FROM train_rows GROUP BY 1)) WHERE rank <= 5")
def _(spark, sf):
    """Top features of every community by their association with what is to be learned, weights compared in full."""
    found = D.association_importance(B.training_rows(dataset(spark, sf)), _ASSOCIATED, "y_log")
    return M.top_features(found.withColumn("weight", F.round("weight", 9)), 5)


@query("boosted_early_stop_o26", f"fold:i, {_WITHIN}", "O26", _OOF_KEYS)
def _(spark, sf):
    """Each fold's trees stop by the last days of its own train rows, before the purge."""
    learner = M.Boosted(_COMPACT_NUM, _COMPACT_CAT, dict(weight="baseline_kw", min_instances=20, trees=10), stop_days=2)
    return _bounded(walk_forward(
        compact_features(staged(dataset(spark, sf), "features")), FOLDS, pooled=True, learner=learner, prepared=True))


@query("lag_guard_p17", "days:i, allowed:i", "P17",
       "SELECT DISTINCT day(ts) - 1 AS days, CASE WHEN day(ts) - 1 >= 2 THEN 1 ELSE 0 END AS allowed FROM events")
def _(spark, sf):
    """Which lags, in days, the argument check lets pass, for every day of the month that the events show."""
    days = [r[0] for r in Meter(spark, sf).events.select((F.dayofmonth("ts") - 1).alias("d")).distinct().orderBy("d").collect()]

    def allowed(n: int) -> int:
        try:
            A.check_lag_days([n])
        except ValueError:
            return 0
        return 1
    return spark.createDataFrame([(n, allowed(n)) for n in days], "days int, allowed int")


# Client bitmaps


@query("distinct_clients_by_day_u2", "community_code:s, day:d, n_clients:i", "U2 O1 A3",
       "SELECT community_code, CAST(datetime_utc AS DATE) AS day, count(DISTINCT client_id) AS n_clients FROM raw_readings GROUP BY 1, 2")
def _(spark, sf):
    readings = Meter(spark, sf).raw_readings
    blocks = client_blocks(readings, client_numbers(readings), KEYS)
    return distinct_clients(blocks.withColumn("day", F.to_date("datetime_utc")), ["community_code", "day"])


@query("distinct_clients_of_communities_u2", "community_code:s, n_clients:i", "U2",
       "SELECT community_code, count(DISTINCT client_id) AS n_clients FROM raw_readings GROUP BY 1")
def _(spark, sf):
    readings = Meter(spark, sf).raw_readings
    return distinct_clients(client_blocks(readings, client_numbers(readings), KEYS), ["community_code"])


@query("panel_from_raw_readings_a2", f"{SLOT}, n_clients:i, n_missing:i, n_new_clients:i, total_kw:f2, mean_kw:f6, median_kw:f2, std_kw:f6", "A2 O1",
       "SELECT community_code, datetime_utc, count(DISTINCT client_id) AS n_clients, count(*) - count(active_kw) AS n_missing, "
       "sum(CASE WHEN datetime_utc = first_utc THEN 1 ELSE 0 END) AS n_new_clients, sum(active_kw) AS total_kw, avg(active_kw) AS mean_kw, "
       "quantile_disc(active_kw, 0.5) AS median_kw, stddev_samp(active_kw) AS std_kw FROM raw_readings JOIN (SELECT client_id, "
       "min(datetime_utc) AS first_utc FROM raw_readings GROUP BY 1) USING (client_id) GROUP BY 1, 2")
def _(spark, sf):
    """Events as they are: a client reads several times in a slot."""
    from wattshare.operators.panel import build_panel

    return build_panel(Meter(spark, sf).raw_readings)


# First-seen state


_SPLIT = "2024-01-20"


@query("first_seen_state_a1", "client_id:s, community_code:s, first_utc:t, n_first:i", "A1 W10",
       "SELECT client_id, community_code, first_utc, count(*) AS n_first FROM raw_readings JOIN (SELECT client_id, community_code, "
       "min(datetime_utc) AS first_utc FROM raw_readings GROUP BY 1, 2) USING (client_id, community_code) WHERE datetime_utc = first_utc GROUP BY 1, 2, 3")
def _(spark, sf):
    """Built of three deliveries, the middle one last."""
    readings, day = Meter(spark, sf).raw_readings, F.col("datetime_utc").cast("date")
    early, late = readings.filter(day < "2024-01-08"), readings.filter(day >= _SPLIT)
    middle = readings.filter((day >= "2024-01-08") & (day < _SPLIT))
    state = staged(S.merged_state(S.state_of(early), S.state_of(late)), "state")
    return S.merged_state(state, S.state_of(middle))


@query("panel_of_new_days_a1_j1", PANEL, "A1 J1 O1", f"SELECT * FROM panel WHERE datetime_utc >= TIMESTAMP '{_SPLIT}'")
def _(spark, sf):
    """Panel rows of the later days from these days' readings and the state, earlier readings unread."""
    readings, day = Meter(spark, sf).readings, F.col("datetime_utc").cast("date")
    before = staged(S.state_of(readings.filter(day < _SPLIT)), "state")
    new = staged(readings.filter(day >= _SPLIT), "new-days")
    after = staged(S.merged_state(before, S.state_of(new)), "state")
    return S.panel_of_new_days(new, after, unique_readings=True)


@query("revised_slots_a1", f"{SLOT}, n_before:i, n_after:i", "A1",
       "WITH o AS (SELECT * FROM readings WHERE CAST(datetime_utc AS DATE) <> DATE '2024-01-03'), c AS (SELECT community_code, datetime_utc, count(*) "
       "AS n FROM o JOIN (SELECT client_id, min(datetime_utc) AS f FROM o GROUP BY 1) USING (client_id) WHERE datetime_utc = f GROUP BY 1, 2), "
       "d AS (SELECT community_code, datetime_utc, count(*) AS n FROM readings JOIN first_seen USING (client_id) WHERE datetime_utc = first_utc "
       "GROUP BY 1, 2) SELECT community_code, datetime_utc, COALESCE(c.n, 0) AS n_before, COALESCE(d.n, 0) AS n_after FROM c FULL JOIN d "
       "USING (community_code, datetime_utc) WHERE c.n IS DISTINCT FROM d.n")
def _(spark, sf):
    """A day delivered late: which counts of new clients it changes, in itself and later."""
    readings, day = Meter(spark, sf).readings, F.col("datetime_utc").cast("date")
    before = staged(S.state_of(readings.filter(day != "2024-01-03")), "state")
    after = staged(S.merged_state(before, S.state_of(readings.filter(day == "2024-01-03"))), "state")
    return S.revised_slots(before, after)


# Snapshots, gaps, quantiles


@query("snapshot_agrees_with_rows_o5", "community_code:s, target_date:d, mean_gap:i, std_gap:i", "O5 W1 W2 W3",
       "SELECT community_code, target_date, 0 AS mean_gap, 0 AS std_gap FROM snapshot")
def _(spark, sf):
    """Merged moments against the rows themselves, in billionths of the value."""
    rows = base(spark, sf, stage=True)
    keys = ["community_code", "target_date"]
    other = A.cutoff_snapshot_by_rows(rows).select(*keys, F.col("sn_alpha_mean_7d").alias("_m"), F.col("sn_alpha_std_7d").alias("_s"))
    both = A.cutoff_snapshot(rows).join(other, keys)

    def gap(a, b):
        near = F.coalesce(F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.abs(F.col(b)) + 1e-15, F.col(a).isNull() & F.col(b).isNull())
        return F.when(near, 0).otherwise(1)
    return both.select(*keys, gap("sn_alpha_mean_7d", "_m").alias("mean_gap"), gap("sn_alpha_std_7d", "_s").alias("std_gap"))


@query("gap_intervals_j10_a5", "community_code:s, gap_start:t, gap_end:t, n_slots:i", "J10 Q8 A5",
       "SELECT community_code, p + INTERVAL 15 MINUTE AS gap_start, datetime_utc - INTERVAL 15 MINUTE AS gap_end, (epoch(datetime_utc) - epoch(p)) "
       "// 900 - 1 AS n_slots FROM (SELECT community_code, datetime_utc, lag(datetime_utc) OVER (PARTITION BY community_code ORDER BY "
       "datetime_utc) AS p FROM panel) WHERE datetime_utc - p > INTERVAL 15 MINUTE")
def _(spark, sf):
    return Q.gap_intervals(panel(spark, sf))


@query("sparse_gaps_j10", "community_code:s, gap_start:t, gap_end:t, n_slots:i", "J10 Q8",
       "SELECT community_code, p + INTERVAL 15 MINUTE AS gap_start, datetime_utc - INTERVAL 15 MINUTE AS gap_end, (epoch(datetime_utc) - epoch(p)) "
       "// 900 - 1 AS n_slots FROM (SELECT community_code, datetime_utc, lag(datetime_utc) OVER (PARTITION BY community_code ORDER BY "
       "datetime_utc) AS p FROM panel WHERE n_clients % 3 = 0) WHERE datetime_utc - p > INTERVAL 15 MINUTE")
def _(spark, sf):
    """The panel with most slots taken out, so that gaps reach over days."""
    return Q.gap_intervals(panel(spark, sf).filter(F.col("n_clients") % 3 == 0))


@query("label_quantiles_a7", "split:s, share:f4, value:f9", "A7 Q10 F12",
       "SELECT split, share, quantile_disc(y, share) AS value FROM (SELECT y, CASE WHEN target_date < DATE '2024-01-20' THEN 'train' ELSE 'valid' "
       "END AS split FROM x) CROSS JOIN (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) s(share) GROUP BY 1, 2"
       .replace("quantile_disc(y, share)", "CASE share WHEN 0.05 THEN quantile_disc(y, 0.05) WHEN 0.25 THEN quantile_disc(y, 0.25) WHEN 0.5 THEN "
                "quantile_disc(y, 0.5) WHEN 0.75 THEN quantile_disc(y, 0.75) ELSE quantile_disc(y, 0.95) END"))
def _(spark, sf):
    rows = staged(holdout(dataset(spark, sf), "2024-01-20").select("split", "y"), "labels")
    return exact_quantiles(rows, ["split"], "y", [0.05, 0.25, 0.5, 0.75, 0.95])


@query("reading_quantiles_a7", "community_code:s, share:f4, value:f2", "A7 F12",
       "SELECT community_code, unnest([0.25, 0.5, 0.75]) AS share, unnest([quantile_disc(active_kw, 0.25), quantile_disc(active_kw, 0.5), "
       "quantile_disc(active_kw, 0.75)]) AS value FROM readings GROUP BY 1")
def _(spark, sf):
    rows = staged(Meter(spark, sf).readings.select("community_code", "active_kw"), "readings")
    return exact_quantiles(rows, ["community_code"], "active_kw", [0.25, 0.5, 0.75])


# Stored tables and folds


@query("rerun_of_days_s7", feature_columns(), "S7 S6", "SELECT * REPLACE (CASE WHEN target_date BETWEEN DATE '2024-01-21' AND DATE '2024-01-22' "
       "THEN total_kw + 1 ELSE total_kw END AS total_kw) FROM x")
def _(spark, sf):
    """Two days written a second time with other values: they are replaced, all others stay."""
    target, rows = _scratch(spark, "features"), staged(dataset(spark, sf), "features")
    tables.save_days(rows, target)
    again = rows.filter(F.col("target_date").between("2024-01-21", "2024-01-22"))
    tables.save_days(again.withColumn("total_kw", F.col("total_kw") + 1), target)
    return tables.load_features(spark, target)


@query("bucketed_lags_s6", f"{SLOT}, alpha_lag_7d:f9, alpha_lag_14d:f9", "S6 J6 W1x",
       "SELECT community_code, datetime_utc, alpha_lag_7d, alpha_lag_14d FROM lagged")
def _(spark, sf):
    """Lags over a table stored in buckets by entity and slot of the day: no exchange."""
    name = f"shares_{uuid.uuid4().hex}"
    tables.save_bucketed(A.with_slot_of_day(base(spark, sf)), name, ["community_code", A.SLOT_OF_DAY], 8, ["datetime_utc"])
    return A.with_alpha_lags(spark.table(name), (7, 14))


_WINDOWS = ("SELECT row_number() OVER (ORDER BY d) - 1 AS fold, d AS valid_start, d + 28 AS valid_end, d - 14 AS train_end FROM (SELECT DISTINCT "
            "CAST(o_orderdate AS DATE) AS d FROM orders)")


@query("many_folds_j16_o23", "fold:i, role:s, n_rows:i, n_clients:i", "J16 O23",
       f"SELECT fold, role, count(*) AS n_rows, sum(n_clients) AS n_clients FROM (SELECT f.fold, 'valid' AS role, b.n_clients FROM base_d b JOIN "
       f"({_WINDOWS}) f ON b.target_date >= f.valid_start AND b.target_date < f.valid_end UNION ALL SELECT f.fold, 'train', b.n_clients FROM base_d b "
       f"JOIN ({_WINDOWS}) f ON b.target_date < f.train_end WHERE f.fold % 100 = 0) GROUP BY 1, 2")
def _(spark, sf):
    """A window of four weeks from every day there is, thousands of them overlapping; every hundredth with its train rows."""
    rows = base_daily(spark, sf).select("target_date", "n_clients")
    days = Daily(spark, sf).orders.select(F.to_date("day").alias("valid_start")).distinct()
    # Numbered by the count of days before, of which the calendar bounds the list.
    listed = days.agg(F.sort_array(F.collect_list("valid_start")).alias("d")).select(F.posexplode("d").alias("fold", "valid_start"))
    folds = staged(listed.select("fold", "valid_start", F.date_add("valid_start", 28).alias("valid_end"),
                                 F.date_sub("valid_start", 14).alias("train_end")), "windows")
    valid = assign_fold_table(rows, folds, valid_only=True)
    train = assign_fold_table(rows, folds.filter(F.col("fold") % 100 == 0)).filter(F.col("role") == "train")
    return valid.unionByName(train).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_clients").alias("n_clients"))
