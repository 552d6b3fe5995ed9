"""Aggregations, error reports, data-quality profiles and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattshare import features
from wattshare.catalog.base import query
from wattshare.catalog.shared import WEEK, base, base_daily, dataset, oof, panel
from wattshare.catalog.sql import CLOCK, FOLDS, METER_MIN_ROWS, share
from wattshare.functions.timegrid import slot_start
from wattshare.operators import diagnostics as D
from wattshare.operators import quality as Q
from wattshare.operators.alpha import with_alpha_lags
from wattshare.operators.baseline import portfolio, with_baseline_d2
from wattshare.operators.calendar import with_calendar
from wattshare.operators.holidays import daily_holidays
from wattshare.operators.panel import (
    build_panel, build_panel_min, client_energy, duplicate_readings, first_seen, null_rate, reclassify_large_clients,
)
from wattshare.operators.validation import holdout
from wattshare.plans.dataset import shares
from wattshare.plans.evaluation import walk_forward
from wattshare.session import staged
from wattshare.sources.fixtures import Daily, Meter

SLOT = "community_code:s, datetime_utc:t"

PANEL = (f"{SLOT}, datetime_local:t, n_clients:i, n_missing:i, n_new_clients:i, total_kw:f2, mean_kw:f6, median_kw:f2, "
         "std_kw:f6, min_kw:f2, max_kw:f2, n_reporting:i, avg_kw_per_client:f6, avg_kw_reporting:f6")


@query("first_observation_a1", "client_id:s, first_utc:t", "A1", "SELECT * FROM first_seen")
def _(spark, sf):
    return first_seen(Meter(spark, sf).readings)


@query("panel_aggregate_a2_o1", PANEL, "A2 O1 P4 P16", "SELECT * FROM panel")
def _(spark, sf):
    return panel(spark, sf)


@query("panel_from_unchecked_readings_a2", PANEL, "A2 O1", "SELECT * FROM panel")
def _(spark, sf):
    return build_panel(Meter(spark, sf).readings)


@query("reduced_panel_a3", f"{SLOT}, total_kw:f2, n_clients:i", "A3", "SELECT * FROM panel")
def _(spark, sf):
    return build_panel_min(Meter(spark, sf).readings)


@query("null_rate_a4_q9", "community_code:s, total_null_readings:i, total_reporting:i, null_pct:f6", "A4 Q9",
       "SELECT community_code, sum(CASE WHEN active_kw IS NULL THEN 1 ELSE 0 END) AS total_null_readings, count(active_kw) AS "
       "total_reporting, 100.0e0 * (count(*) - count(active_kw)) / count(*) AS null_pct FROM readings GROUP BY 1")
def _(spark, sf):
    return null_rate(panel(spark, sf))


@query("continuity_a5_q8", "community_code:s, first_utc:t, last_utc:t, actual_rows:i, expected_rows:i, internal_gaps:i", "A5 Q8 T7",
       "SELECT *, expected_rows - actual_rows AS internal_gaps FROM (SELECT community_code, min(datetime_utc) AS first_utc, "
       "max(datetime_utc) AS last_utc, count(*) AS actual_rows, CAST(epoch(max(datetime_utc)) - epoch(min(datetime_utc)) AS BIGINT) "
       "// 900 + 1 AS expected_rows FROM panel GROUP BY 1)")
def _(spark, sf):
    return Q.continuity(panel(spark, sf))


@query("extent_a6", "min_date:d, max_date:d, n_communities:i, n_days:i", "A6",
       "SELECT min(target_date) AS min_date, max(target_date) AS max_date, count(DISTINCT community_code) AS n_communities, "
       "count(DISTINCT target_date) AS n_days FROM x")
def _(spark, sf):
    return Q.extent(dataset(spark, sf))


_LABEL = "split:s, n_rows:i, mean:f9, std:f9, min:f9, p25:f9, median:f9, p75:f9, max:f9"


@query("label_summary_a7_q10", _LABEL, "A7 Q10 O22",
       "SELECT split, count(*) AS n_rows, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS min, quantile_disc(y, 0.25) AS p25, "
       "quantile_disc(y, 0.5) AS median, quantile_disc(y, 0.75) AS p75, max(y) AS max FROM (SELECT *, CASE WHEN target_date "
       "< DATE '2024-01-20' THEN 'train' ELSE 'valid' END AS split FROM x) GROUP BY split")
def _(spark, sf):
    return Q.label_summary(holdout(dataset(spark, sf), "2024-01-20"))


@query("monthly_cutoff_a8_q7", "target_month:s, avg_n_clients:f6, min_n_clients:i, max_n_clients:i, n_null:i", "A8 Q7 F1",
       "SELECT strftime(target_date, '%Y-%m') AS target_month, avg(n_clients_at_cutoff) AS avg_n_clients, "
       "min(n_clients_at_cutoff) AS min_n_clients, max(n_clients_at_cutoff) AS max_n_clients, "
       "count(*) - count(n_clients_at_cutoff) AS n_null FROM x GROUP BY 1")
def _(spark, sf):
    return Q.monthly_cutoff_profile(dataset(spark, sf))


@query("demand_coverage_a9_q7", "total:i, d_mw_null:i", "A9 Q7",
       "SELECT count(*) AS total, count(*) - count(D_mw) AS d_mw_null FROM base WHERE target_date <= DATE '2024-01-25'")
def _(spark, sf):
    return Q.demand_coverage(base(spark, sf), "2024-01-25")


_PROFILED = ["y", *features.FEATURES]


@query("null_profile_a10_q6", "feature:s, n_nulls:i, null_pct:f6", "A10 Q6",
       " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_nulls, 100.0e0 * (count(*) - count({c})) / count(*) "
                          "AS null_pct FROM x" for c in _PROFILED))
def _(spark, sf):
    return Q.null_profile(dataset(spark, sf), _PROFILED)


@query("missing_rows_a11_q6", "n_rows:i, all_lags_null:i, snapshot_null:i, demand_null:i", "A11 Q6",
       "SELECT count(*) AS n_rows, count(*) FILTER (COALESCE(alpha_lag_2d, alpha_lag_7d, alpha_lag_14d, alpha_lag_21d, "
       "alpha_lag_28d) IS NULL) AS all_lags_null, count(*) FILTER (sn_alpha_last IS NULL) AS snapshot_null, "
       "count(*) FILTER (D_mw IS NULL) AS demand_null FROM x")
def _(spark, sf):
    return Q.missing_rows(dataset(spark, sf), features.LAGS)


@query("client_energy_a12", "client_id:s, community_code:s, total_kw:f2", "A12",
       "SELECT client_id, NULL AS community_code, sum(active_kw) AS total_kw FROM readings GROUP BY 1 UNION ALL "
       "SELECT client_id, community_code, sum(active_kw) FROM readings GROUP BY 1, 2")
def _(spark, sf):
    readings = Meter(spark, sf).readings
    alone = client_energy(readings).withColumn("community_code", F.lit(None).cast("string"))
    return alone.unionByName(client_energy(readings, ("client_id", "community_code")))


_SLOTS = "datetime_utc:t, actual:f2, baseline:f4, pred:f4"


@query("portfolio_rollup_a13", _SLOTS, "A13",
       "SELECT datetime_utc, sum(total_kw) AS actual, sum(baseline_kw) AS baseline, sum(pred_kw) AS pred FROM oof GROUP BY 1")
def _(spark, sf):
    return portfolio(oof(spark, sf), D.TOTALS)


_MAE = "mae_base:f4, mae_model:f4, n_points:i, gain_kw:f4, lift_pct:f4"


def _mae_sql(rows: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return (f"SELECT *, mae_base - mae_model AS gain_kw, CASE WHEN mae_base > 0 THEN (1 - mae_model / mae_base) * 100 END AS "
            f"lift_pct FROM (SELECT {head}avg(abs(baseline - actual)) AS mae_base, avg(abs(pred - actual)) AS mae_model, "
            f"count(*) AS n_points FROM ({rows}){tail})")


_ALL_SLOTS = "SELECT datetime_utc, sum(actual) AS actual, sum(baseline) AS baseline, sum(pred) AS pred FROM oof_slots GROUP BY 1"


@query("overall_error_a14_a15", _MAE, "A14 A15", _mae_sql(_ALL_SLOTS))
def _(spark, sf):
    return D.mae(oof(spark, sf))


@query("fold_error_a14", f"fold:i, {_MAE}", "A14", _mae_sql("SELECT * FROM oof_slots", "fold"))
def _(spark, sf):
    return D.mae(oof(spark, sf), by=["fold"])


def _lift_sql(by: str, rows: str = "oof") -> str:
    return (f"SELECT *, CASE WHEN mae_base > 0 THEN (1 - mae_model / mae_base) * 100 END AS lift_pct FROM (SELECT {by}, "
            f"avg(abs(baseline_kw - total_kw)) AS mae_base, avg(abs(pred_kw - total_kw)) AS mae_model, count(*) AS n "
            f"FROM {rows} GROUP BY ALL)")


_LIFT = "mae_base:f4, mae_model:f4, n:i, lift_pct:f4"


@query("fold_community_lift_a16", f"fold:i, community_code:s, {_LIFT}", "A16", _lift_sql("fold, community_code"))
def _(spark, sf):
    return D.lift_by(oof(spark, sf), ["fold", "community_code"])


@query("lift_pivot_a17", "community_code:s, fold_0:f4, fold_1:f4, fold_2:f4", "A17",
       "SELECT community_code, " + ", ".join(f"max(lift_pct) FILTER (fold = {i}) AS fold_{i}" for i in range(3))
       + f" FROM ({_lift_sql('fold, community_code')}) GROUP BY 1")
def _(spark, sf):
    return D.lift_pivot(oof(spark, sf), range(len(FOLDS)))


@query("community_lift_a18", f"community_code:s, {_LIFT}", "A18", _lift_sql("community_code"))
def _(spark, sf):
    return D.lift_by(oof(spark, sf), ["community_code"]).orderBy("lift_pct")


@query("daily_error_a19", "date:d, actual:f2, baseline:f4, pred:f4, err_model:f4, err_base:f4, lift_pct:f4", "A19",
       "SELECT *, CASE WHEN err_base > 0 THEN (1 - err_model / err_base) * 100 END AS lift_pct FROM (SELECT *, abs(pred - actual) AS "
       "err_model, abs(baseline - actual) AS err_base FROM (SELECT CAST(datetime_utc AS DATE) AS date, sum(total_kw) AS actual, "
       "sum(baseline_kw) AS baseline, sum(pred_kw) AS pred FROM oof GROUP BY 1))")
def _(spark, sf):
    return D.daily_error(oof(spark, sf))


@query("holiday_error_a20", f"is_hol:i, {_LIFT}", "A20",
       _lift_sql("is_hol", "(SELECT *, CASE WHEN CAST(datetime_utc AS DATE) IN (SELECT target_date FROM x WHERE is_holiday = 1) "
                           "THEN 1 ELSE 0 END AS is_hol FROM oof)"))
def _(spark, sf):
    rows = staged(dataset(spark, sf), "features")
    return D.holiday_error(walk_forward(rows, FOLDS, False, METER_MIN_ROWS), daily_holidays(rows))


@query("weekday_hour_error_a21", f"dow:i, hour:i, {_LIFT}", "A21",
       _lift_sql("isodow(datetime_utc) - 1 AS dow, hour(datetime_utc) AS hour"))
def _(spark, sf):
    return D.cell_error(oof(spark, sf))


@query("weekday_hour_matrix_a21", "dow:i, " + ", ".join(f"h{h:02d}:f4" for h in range(24)), "A21",
       "SELECT dow, " + ", ".join(f"max(mae_model) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
       + f" FROM ({_lift_sql('isodow(datetime_utc) - 1 AS dow, hour(datetime_utc) AS hour')}) GROUP BY dow")
def _(spark, sf):
    return D.cell_matrix(oof(spark, sf), "mae_model")


_CORRELATED = [c for c in features.FEATURES if c not in features.CATEGORICAL]


@query("correlations_a22", "feature:s, corr:f6", "A22 T7",
       " UNION ALL ".join(
           f"SELECT '{c}' AS feature, CASE WHEN max({c}) > min({c}) AND max(y) FILTER ({c} IS NOT NULL) > min(y) FILTER ({c} IS NOT NULL) "
           f"THEN corr({c}, y) END AS corr FROM x WHERE target_date < DATE '2024-01-20'" for c in _CORRELATED))
def _(spark, sf):
    rows = dataset(spark, sf)
    return D.correlations(rows.filter(F.col("target_date") < F.lit("2024-01-20").cast("date")), _CORRELATED)


@query("rows_per_community_a23", "community_code:s, n_rows:i, n_not_positive:i", "A23",
       "SELECT community_code, count(*) AS n_rows, count(*) FILTER (total_kw <= 0) AS n_not_positive FROM x GROUP BY 1")
def _(spark, sf):
    return Q.rows_per_community(dataset(spark, sf))


@query("daily_holiday_max_a24", "community_code:s, target_date:d, is_holiday:i", "A24", "SELECT * FROM holiday_numbered_d")
def _(spark, sf):
    return daily_holidays(base_daily(spark, sf))


@query("validation_profile_a25", "community_code:s, n_rows:i, avg_alpha:f9, avg_n_clients:f6, avg_d_mw:f4", "A25",
       "SELECT community_code, count(*) AS n_rows, avg(y) AS avg_alpha, avg(n_clients_at_cutoff) AS avg_n_clients, "
       "avg(D_mw) AS avg_d_mw FROM x WHERE target_date >= DATE '2024-01-20' GROUP BY 1")
def _(spark, sf):
    rows = holdout(dataset(spark, sf), "2024-01-20").filter(F.col("split") == "valid")
    return Q.community_profile(rows)


def _entity_base_sql(readings: str) -> str:
    return (f"SELECT p.*, d.value AS D_mw, {share('p.total_kw', 'p.n_clients', 'd.value')} AS alpha FROM (SELECT community_code, "
            f"datetime_utc, sum(active_kw) AS total_kw, count(DISTINCT client_id) AS n_clients FROM ({readings}) GROUP BY 1, 2) p "
            "LEFT JOIN demand_d d USING (datetime_utc)")


def _seasonal_sql(readings: str, variant: str) -> str:
    return (f"SELECT '{variant}' AS variant, count(*) AS n_points, avg(abs(baseline - actual)) AS mae_base FROM (SELECT datetime_utc, "
            f"sum(total_kw) AS actual, sum(baseline_kw) AS baseline FROM (SELECT b.datetime_utc, b.total_kw, l7.alpha * l2.n_clients "
            f"* b.D_mw AS baseline_kw FROM ({_entity_base_sql(readings)}) b JOIN ({_entity_base_sql(readings)}) l7 ON l7.community_code "
            f"= b.community_code AND l7.datetime_utc = b.datetime_utc - INTERVAL '7' DAY JOIN ({_entity_base_sql(readings)}) l2 ON "
            "l2.community_code = b.community_code AND l2.datetime_utc = b.datetime_utc - INTERVAL '2' DAY) WHERE baseline_kw IS NOT "
            "NULL AND month(datetime_utc) IN (12, 1, 2) GROUP BY 1)")


_APART_D = ("SELECT r.* REPLACE (CASE WHEN t.client_id IS NOT NULL THEN 'BIG_' || r.client_id ELSE r.community_code END AS "
            "community_code) FROM readings_d r LEFT JOIN (SELECT client_id FROM readings_d GROUP BY 1 ORDER BY sum(active_kw) DESC "
            "NULLS LAST, client_id LIMIT 10) t ON t.client_id = r.client_id")


@query("winter_error_a26", "variant:s, n_points:i, mae_base:f2", "A26 O2 O10b",
       _seasonal_sql("SELECT * FROM readings_d", "communities") + " UNION ALL " + _seasonal_sql(_APART_D, "large_clients_apart"))
def _(spark, sf):
    d = Daily(spark, sf)

    def winter_rows(readings):
        return with_baseline_d2(shares(readings, d.demand)).dropna(subset=["baseline_kw"])

    return D.compare_seasonal(winter_rows(d.readings), winter_rows(reclassify_large_clients(d.readings, 10)))


_CHOSEN = ["2024-01-15", "2024-01-17", "2024-01-26", "2024-01-28"]
_CHOSEN_SQL = ", ".join(f"DATE '{d}'" for d in _CHOSEN)


@query("date_list_error_a27", f"date:d, {_MAE}", "A27 P9",
       _mae_sql("SELECT CAST(datetime_utc AS DATE) AS date, datetime_utc, sum(total_kw) AS actual, sum(baseline_kw) AS baseline, "
                f"sum(pred_kw) AS pred FROM oof WHERE CAST(datetime_utc AS DATE) IN ({_CHOSEN_SQL}) GROUP BY 1, 2", "date"))
def _(spark, sf):
    return D.date_list_error(oof(spark, sf), _CHOSEN)


_WEEKS = ["2024-01-14", "2024-01-20"]


@query("week_slice_error_a28", f"week_start:t, {_MAE}", "A28",
       _mae_sql("SELECT w.week_start, o.datetime_utc, sum(o.actual) AS actual, sum(o.baseline) AS baseline, sum(o.pred) AS pred FROM "
                "oof_slots o JOIN (VALUES (TIMESTAMP '2024-01-14'), (TIMESTAMP '2024-01-20')) w(week_start) ON o.datetime_utc >= "
                "w.week_start AND o.datetime_utc <= w.week_start + INTERVAL '7' DAY GROUP BY 1, 2", "week_start"))
def _(spark, sf):
    return D.week_error(oof(spark, sf), _WEEKS)


@query("scalar_counts_a29", "n_readings:i, n_slots:i", "A29",
       "SELECT (SELECT count(*) FROM readings) AS n_readings, (SELECT count(*) FROM panel) AS n_slots")
def _(spark, sf):
    counted = Meter(spark, sf).readings.groupBy("community_code", "datetime_utc").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.sum("n").alias("n_readings"), F.count(F.lit(1)).alias("n_slots"))


CHECK = "rule:s, violations:i"


_PANEL_RULES = ["row_missing", "n_clients", "n_missing", "total_kw", "mean_kw", "n_reporting"]


def _panel_check(readings: str, panel: str) -> str:
    """Violations of a panel against its readings, both sides recomputed."""
    def far(a, b):
        return f"abs({a} - {b}) > 1e-6 OR ({a} IS NULL) <> ({b} IS NULL)"
    bad = ["p.community_code IS NULL OR r.community_code IS NULL", far("p.n_clients", "r_clients"), far("p.n_missing", "r_missing"),
           far("p.total_kw", "r_total"), far("p.mean_kw", "r_mean"), "p.n_reporting <> r_clients - r_missing"]
    counts = ", ".join(f"count(*) FILTER ({b})" for b in bad)
    return (f"SELECT unnest({_PANEL_RULES}) AS rule, unnest([{counts}]) AS violations FROM {panel} p FULL JOIN (SELECT community_code, "
            "datetime_utc, count(DISTINCT client_id) AS r_clients, count(*) - count(active_kw) AS r_missing, sum(active_kw) AS r_total, "
            f"sum(active_kw) / count(active_kw) AS r_mean FROM {readings} GROUP BY 1, 2) r ON r.community_code = p.community_code AND "
            "r.datetime_utc = p.datetime_utc")


@query("panel_check_q1", CHECK, "Q1", _panel_check("readings", "panel"))
def _(spark, sf):
    m = Meter(spark, sf)
    return Q.check_panel(m.readings, build_panel(m.readings, unique_readings=True))


@query("alpha_check_q2", CHECK, "Q2",
       f"SELECT 'alpha' AS rule, count(*) FILTER (abs(y - {share('total_kw', 'n_clients', 'D_mw')}) > 1e-6) AS violations FROM x")
def _(spark, sf):
    return Q.check_alpha(dataset(spark, sf))


_SNAPSHOT_CHECK = (
    "SELECT unnest(['sn_alpha_last', 'n_clients_at_cutoff']) AS rule, unnest([count(*) FILTER (abs(lo - c.alpha) > 1e-6 OR abs(hi - "
    "c.alpha) > 1e-6 OR (lo IS NULL) <> (c.alpha IS NULL)), count(*) FILTER (abs(n_lo - c.n_clients) > 0 OR abs(n_hi - c.n_clients) > 0 OR "
    "(n_lo IS NULL) <> (c.n_clients IS NULL))]) AS violations FROM (SELECT community_code, target_date, min(sn_alpha_last) AS lo, "
    "max(sn_alpha_last) AS hi, min(n_clients_at_cutoff) AS n_lo, max(n_clients_at_cutoff) AS n_hi FROM x GROUP BY 1, 2) d LEFT JOIN base c "
    "ON c.community_code = d.community_code AND c.datetime_local = CAST(d.target_date AS TIMESTAMP) - INTERVAL '735' MINUTE")


@query("snapshot_check_q4", CHECK, "Q4", _SNAPSHOT_CHECK)
def _(spark, sf):
    return Q.check_snapshot(dataset(spark, sf), base(spark, sf))


@query("leakage_check_q7", CHECK, "Q7",
       "SELECT unnest(['label_null', 'short_history']) AS rule, unnest([count(*) FILTER (y IS NULL), count(*) FILTER (x.target_date - "
       "f.first_date < 7)]) AS violations FROM x JOIN first_dates f USING (community_code)")
def _(spark, sf):
    return Q.check_leakage(dataset(spark, sf), Meter(spark, sf).readings, WEEK)


@query("panel_check_altered_q1", CHECK, "Q1",
       "SELECT rule, sum(bad) AS violations FROM (SELECT unnest(['row_missing', 'n_clients', 'n_missing', 'total_kw', 'mean_kw', "
       "'n_reporting']) AS rule, unnest([CASE WHEN n_clients > 2 THEN 1 ELSE 0 END, CASE WHEN n_clients > 2 THEN 1 ELSE 0 END, CASE WHEN "
       "n_clients > 2 THEN 1 ELSE 0 END, CASE WHEN total_kw IS NOT NULL AND (n_clients > 2 OR n_missing > 0) THEN 1 ELSE 0 END, CASE WHEN "
       "total_kw IS NOT NULL AND n_clients > 2 THEN 1 ELSE 0 END, 0]) AS bad FROM panel) GROUP BY rule")
def _(spark, sf):
    """Slots above two clients are lost, and a total is off by one where a reading is missing."""
    readings = Meter(spark, sf).readings
    intact = build_panel(readings, unique_readings=True)
    total = F.col("total_kw") + F.when(F.col("n_missing") > 0, 1.0).otherwise(0.0)
    return Q.check_panel(readings, intact.filter(F.col("n_clients") <= 2).withColumn("total_kw", total))


@query("alpha_check_altered_q2", CHECK, "Q2",
       "SELECT 'alpha' AS rule, count(*) AS violations FROM x WHERE community_code = 'view' AND y > 1e-5")
def _(spark, sf):
    """One community's label is doubled."""
    factor = F.when(F.col("community_code") == "view", 2.0).otherwise(1.0)
    return Q.check_alpha(dataset(spark, sf).withColumn("y", F.col("y") * factor))


@query("lag_check_altered_q3", CHECK, "Q3",
       "SELECT rule, count(*) FILTER (bad) AS violations FROM (SELECT unnest(['alpha_lag_2d', 'alpha_lag_7d']) AS rule, "
       "unnest([COALESCE(abs(alpha - alpha_lag_2d) > 1e-6, (alpha IS NULL) <> (alpha_lag_2d IS NULL)), alpha_lag_7d IS NOT NULL]) AS bad "
       "FROM lagged) GROUP BY rule")
def _(spark, sf):
    """The two-day lag shows today's share, the weekly lag is blank."""
    rows = base(spark, sf, stage=True)
    wrong = with_alpha_lags(rows, (2, 7)).withColumns({
        "alpha_lag_2d": F.col("alpha"), "alpha_lag_7d": F.lit(None).cast("double")})
    return Q.check_lags(wrong, rows, (2, 7))


@query("snapshot_check_altered_q4", CHECK, "Q4",
       "SELECT unnest(['sn_alpha_last', 'n_clients_at_cutoff']) AS rule, unnest([0, count(DISTINCT (community_code, target_date)) FILTER "
       "(n_clients_at_cutoff >= 2)]) AS violations FROM x")
def _(spark, sf):
    """Client counts of two and more are one too high."""
    n = F.col("n_clients_at_cutoff")
    wrong = dataset(spark, sf).withColumn("n_clients_at_cutoff", n + F.when(n >= 2, 1).otherwise(0))
    return Q.check_snapshot(wrong, base(spark, sf))


_CLOCK_COLUMNS = ["hour", "qhour", "mod", "dow", "month", "doy", "is_weekend", "sin_mod", "cos_mod"]


def _clock_check(found: str) -> str:
    """Violations of the calendar columns of ``found`` (x with its clock columns) against the local clock."""
    again = CLOCK.replace(" AS ", " AS r_")
    bad = ", ".join(f"count(*) FILTER (abs({c} - r_{c}) > 1e-6)" for c in _CLOCK_COLUMNS)
    return (f"SELECT unnest({_CLOCK_COLUMNS}) AS rule, unnest([{bad}]) AS violations FROM (SELECT *, {again} FROM ({found}))")


@query("calendar_check_q5", CHECK, "Q5",
       _clock_check("SELECT datetime_local, " + ", ".join(_CLOCK_COLUMNS) + " FROM x"))
def _(spark, sf):
    return Q.check_calendar(dataset(spark, sf))


@query("calendar_check_altered_q5", CHECK, "Q5",
       _clock_check(f"SELECT datetime_local, {CLOCK.replace('datetime_local', 'datetime_utc')} FROM x"))
def _(spark, sf):
    """Calendar taken from UTC where the local clock was meant."""
    utc = with_calendar(dataset(spark, sf), ts="datetime_utc")
    return Q.check_calendar(utc)


@query("leakage_check_longer_history_q7", CHECK, "Q7",
       "SELECT unnest(['label_null', 'short_history']) AS rule, unnest([0, count(*) FILTER (age_days < 14)]) AS violations FROM x")
def _(spark, sf):
    """One week of history was required, two are asked for."""
    return Q.check_leakage(dataset(spark, sf), Meter(spark, sf).readings, 14)


@query("grid_fill_q11", "n_communities:i, n_slots:i, n_rows:i, n_cells:i", "Q11 A6",
       "SELECT *, n_communities * n_slots AS n_cells FROM (SELECT count(DISTINCT community_code) AS n_communities, "
       "count(DISTINCT datetime_utc) AS n_slots, count(*) AS n_rows FROM panel)")
def _(spark, sf):
    return Q.grid_fill(panel(spark, sf))


@query("duplicate_readings_q1", "client_id:s, community_code:s, datetime_utc:t, n_rows:i", "Q1",
       "SELECT CAST(user_id AS VARCHAR) AS client_id, event_type AS community_code, time_bucket(INTERVAL '15 minutes', ts) AS "
       "datetime_utc, count(*) AS n_rows FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(spark, sf):
    raw = Meter(spark, sf).events.select(
        F.col("user_id").cast("string").alias("client_id"), F.col("event_type").alias("community_code"),
        slot_start("ts").alias("datetime_utc"))
    return duplicate_readings(raw)
