"""Domain operators: entities, features, baselines, models, validation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattshare import features
from wattshare.catalog.base import query
from wattshare.catalog.shared import WEEK, base, base_daily, dataset, oof
from wattshare.catalog.source_queries import feature_columns
from wattshare.catalog.sql import CLOCK, CYCLIC, FOLDS, HOL_TYPE, METER_MIN_ROWS, cell_median, floor_at, share
from wattshare.operators import alpha as A
from wattshare.operators import baseline as B
from wattshare.operators import calendar as C
from wattshare.operators import holidays as H
from wattshare.operators import model as M
from wattshare.operators import validation as V
from wattshare.operators import weather as W
from wattshare.operators.panel import reclassify_large_clients
from wattshare.plans import evaluation
from wattshare.plans.dataset import (
    build_alpha_dataset, build_short_dataset, compact_features, history_filter, rich_features,
)
from wattshare.session import staged
from wattshare.sources import tables
from wattshare.sources.fixtures import Daily, Meter

SLOT = "community_code:s, datetime_utc:t"

_TOP = """(SELECT client_id FROM readings {where} GROUP BY 1 ORDER BY sum(active_kw) DESC NULLS LAST, client_id LIMIT {n})"""


def _apart(n: int, until: str | None = None) -> str:
    where = f"WHERE datetime_local < TIMESTAMP '{until}'" if until else ""
    return (f"SELECT r.* REPLACE (CASE WHEN t.client_id IS NOT NULL THEN 'BIG_' || r.client_id ELSE r.community_code END AS "
            f"community_code) FROM readings r LEFT JOIN {_TOP.format(where=where, n=n)} t ON t.client_id = r.client_id")


def _entity_base(readings: str, demand: str = "demand", trunc: bool = True) -> str:
    hour = "date_trunc('hour', p.datetime_utc)" if trunc else "p.datetime_utc"
    return (f"SELECT p.*, d.value AS D_mw, {share('p.total_kw', 'p.n_clients', 'd.value')} AS alpha, CAST(p.datetime_local AS DATE) AS "
            f"target_date FROM (SELECT community_code, datetime_utc, min(datetime_local) AS datetime_local, sum(active_kw) AS total_kw, "
            f"count(DISTINCT client_id) AS n_clients FROM ({readings}) GROUP BY 1, 2) p LEFT JOIN {demand} d ON d.datetime_utc = {hour}")


def _baseline_d2(entities: str, key: str = "community_code") -> str:
    keys = [k.strip() for k in key.split(",")]
    def on(a):
        return " AND ".join(f"{a}.{k} = b.{k}" for k in keys)
    return (f"WITH e AS MATERIALIZED ({entities}) SELECT *, total_kw - baseline_kw AS residual FROM (SELECT b.*, l7.alpha AS alpha_d7, "
            f"l2.n_clients AS n_clients_d2, l7.alpha * l2.n_clients * b.D_mw AS baseline_kw FROM e b LEFT JOIN e l7 ON {on('l7')} AND "
            f"l7.datetime_utc = b.datetime_utc - INTERVAL '7' DAY LEFT JOIN e l2 ON {on('l2')} AND l2.datetime_utc = b.datetime_utc "
            "- INTERVAL '2' DAY)")


@query("large_clients_apart_o2", f"client_id:s, {SLOT}, active_kw:f2", "O2 J9", _apart(30))
def _(spark, sf):
    return reclassify_large_clients(Meter(spark, sf).readings, 30)


@query("large_clients_fit_until_o2", f"client_id:s, {SLOT}, active_kw:f2", "O2", _apart(30, "2024-01-15"))
def _(spark, sf):
    return reclassify_large_clients(Meter(spark, sf).readings, 30, fit_until="2024-01-15")


@query("demand_share_o3", f"{SLOT}, D_mw:f4, alpha:f9, target_date:d", "O3", "SELECT * FROM base")
def _(spark, sf):
    return base(spark, sf)


@query("cutoff_snapshot_o5", "community_code:s, target_date:d, sn_alpha_last:f9, sn_alpha_mean_24h:f9, sn_alpha_mean_7d:f9, "
       "sn_alpha_std_7d:f9, n_clients_at_cutoff:i", "O5 W1 W2 W3", "SELECT * FROM snapshot")
def _(spark, sf):
    return A.cutoff_snapshot(base(spark, sf, stage=True))


@query("count_snapshot_o5b", "community_code:s, target_date:d, n_clients_at_cutoff:i", "O5b", "SELECT * FROM snapshot")
def _(spark, sf):
    return A.client_count_snapshot(base(spark, sf))


@query("calendar_clock_o6", f"{SLOT}, hour:i, qhour:i, mod:i, dow:i, month:i, doy:i, is_weekend:i, sin_mod:f6, cos_mod:f6, "
       "sin_dow:f6, cos_dow:f6", "O6", f"SELECT community_code, datetime_utc, {CLOCK} FROM base")
def _(spark, sf):
    return C.with_calendar(base(spark, sf))


@query("calendar_cyclic_o6b", "community_code:s, datetime_utc:t, qhour:i, dow:i, dom:i, doy:i, month:i, is_weekend:i, sin_qhour:f6, "
       "cos_qhour:f6, sin_dow:f6, cos_dow:f6, sin_doy:f6, cos_doy:f6", "O6b",
       f"SELECT community_code, datetime_utc, {CYCLIC} FROM base")
def _(spark, sf):
    return C.with_calendar(base(spark, sf), "cyclic")


_YEAR = ", ".join(f"sin(2 * pi() * {k} * doy / 365.25e0) AS sin_doy_{k}, cos(2 * pi() * {k} * doy / 365.25e0) AS cos_doy_{k}" for k in range(1, 5))


@query("fourier_week_bins_o6c", "o_orderkey:i, hour_of_week:i, qhour_of_week:i, "
       + ", ".join(f"sin_doy_{k}:f6, cos_doy_{k}:f6" for k in range(1, 5)), "O6c",
       f"SELECT o_orderkey, dow * 24 + hour AS hour_of_week, dow * 96 + mod AS qhour_of_week, {_YEAR} FROM (SELECT o_orderkey, {CLOCK} "
       "FROM (SELECT o_orderkey, o_orderdate AS datetime_local FROM orders))")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("datetime_local"))
    return C.with_week_bins(C.with_fourier(C.with_calendar(orders)))


@query("daylight_o14", "o_orderkey:i, doy:i, daylight_h:f6", "O14",
       "SELECT o_orderkey, doy, 24 * acos(greatest(-1.0, least(1.0, -tan(radians(40.0)) * tan(0.4093e0 * sin(2 * pi() * (doy - 81) "
       "/ 365.25e0))))) / pi() AS daylight_h FROM (SELECT o_orderkey, dayofyear(o_orderdate) AS doy FROM orders)")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.dayofyear("o_orderdate").alias("doy"))
    return C.with_daylight(orders)


@query("history_filter_o8", f"{SLOT}, target_date:d, alpha:f9", "O8 J8 W10",
       "SELECT b.* FROM base b JOIN first_dates f USING (community_code) WHERE b.target_date - f.first_date >= 28 AND b.alpha IS NOT NULL")
def _(spark, sf):
    return history_filter(base(spark, sf), 28, label="alpha")


@query("alpha_dataset_o9", feature_columns(), "O9 O4 O5 O6 O7 O8 P1", "SELECT * FROM x28")
def _(spark, sf):
    return dataset(spark, sf, 28)


@query("alpha_dataset_week_history_o9", feature_columns(), "O9", "SELECT * FROM x")
def _(spark, sf):
    return dataset(spark, sf)


@query("alpha_dataset_without_weather_o9", "community_code:s, datetime_utc:t, y:f9, alpha_lag_7d:f9, n_clients_at_cutoff:i, is_holiday:i",
       "O9 P15", "SELECT * EXCLUDE (is_holiday), 0 AS is_holiday FROM x")
def _(spark, sf):
    m = Meter(spark, sf)
    return build_alpha_dataset(m.readings, m.demand, min_history_days=WEEK, unique_readings=True)


@query("short_dataset_o9", "community_code:s, target_date:d, datetime_utc:t, total_kw:f2, n_clients:i, y:f9, alpha_lag_2d:f9, "
       "alpha_lag_7d:f9, n_clients_at_cutoff:i, D_mw:f4, mod:i, dow:i, is_holiday:i", "O9 O2 O5b",
       f"WITH e AS MATERIALIZED ({_entity_base(_apart(10))}) SELECT b.*, b.alpha AS y, l2.alpha AS alpha_lag_2d, l7.alpha AS alpha_lag_7d, "
       "c.n_clients AS n_clients_at_cutoff, hour(b.datetime_local) * 4 + minute(b.datetime_local) // 15 AS mod, "
       "dayofweek(b.datetime_local) + 1 AS dow, CASE WHEN b.target_date IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday "
       "FROM e b LEFT JOIN e l2 ON l2.community_code = b.community_code AND l2.datetime_utc = b.datetime_utc - INTERVAL '2' DAY "
       "LEFT JOIN e l7 ON l7.community_code = b.community_code AND l7.datetime_utc = b.datetime_utc - INTERVAL '7' DAY "
       "LEFT JOIN e c ON c.community_code = b.community_code AND c.target_date = b.target_date - 1 AND hour(c.datetime_local) = 11 "
       "AND minute(c.datetime_local) = 45 JOIN (SELECT community_code, min(target_date) AS f FROM e GROUP BY 1) f "
       "ON f.community_code = b.community_code WHERE b.alpha IS NOT NULL AND b.target_date - f.f >= 7")
def _(spark, sf):
    m = Meter(spark, sf)
    return build_short_dataset(m.readings, m.demand, m.holidays, min_history_days=WEEK, top_n=10, unique_readings=True)


@query("baseline_cutoff_o10", f"{SLOT}, baseline_kw:f4", "O10",
       "SELECT community_code, datetime_utc, alpha_lag_7d * n_clients_at_cutoff * D_mw AS baseline_kw FROM x")
def _(spark, sf):
    return B.with_baseline(dataset(spark, sf))


_D2 = f"{SLOT}, alpha_d7:f9, n_clients_d2:i, baseline_kw:f4, residual:f4"


@query("baseline_two_days_o10b", _D2, "O10b O11", _baseline_d2("SELECT * FROM base"))
def _(spark, sf):
    return B.with_residual(B.with_baseline_d2(base(spark, sf)), "kw")


@query("baseline_positional_o10b", f"{SLOT}, baseline_kw:f4", "O10b W4 W5",
       "WITH e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY community_code ORDER BY datetime_utc) AS i FROM base) SELECT "
       "b.community_code, b.datetime_utc, l7.alpha * l2.n_clients * b.D_mw AS baseline_kw FROM e b LEFT JOIN e l7 ON l7.community_code "
       "= b.community_code AND l7.i = b.i - 672 LEFT JOIN e l2 ON l2.community_code = b.community_code AND l2.i = b.i - 192")
def _(spark, sf):
    return B.with_baseline_d2(base(spark, sf), positional=True)


@query("residual_targets_o11", f"{SLOT}, r_kw:f4, r_alpha:f9, r_log:f6", "O11 P11",
       "SELECT community_code, datetime_utc, total_kw - b AS r_kw, y - alpha_lag_7d AS r_alpha, "
       f"ln({floor_at('total_kw', '1.0')}) - ln({floor_at('b', '1.0')}) AS r_log FROM (SELECT *, alpha_lag_7d * n_clients_at_cutoff * D_mw "
       "AS b FROM x)")
def _(spark, sf):
    rows = B.with_baseline(dataset(spark, sf))
    for kind in ("kw", "alpha", "log"):
        rows = B.with_residual(rows, kind, f"r_{kind}")
    return rows


@query("inverse_targets_o12", f"{SLOT}, p_kw:f4, p_alpha:f4, p_log:f4, p_bounded:f4", "O12",
       "SELECT community_code, datetime_utc, b + c AS p_kw, (alpha_lag_7d + c) * n_clients_at_cutoff * D_mw AS p_alpha, b * exp(c) AS "
       "p_log, greatest(0.0, b * exp(greatest(-0.1, least(0.1, c)))) AS p_bounded FROM (SELECT *, alpha_lag_7d * n_clients_at_cutoff * "
       "D_mw AS b, sin_mod AS c FROM x WHERE alpha_lag_7d * n_clients_at_cutoff * D_mw IS NOT NULL)")
def _(spark, sf):
    rows = B.with_baseline(dataset(spark, sf)).dropna(subset=["baseline_kw"])
    rows = B.from_residual(rows, "kw", "sin_mod", name="p_kw")
    rows = B.from_residual(rows, "alpha", "sin_mod", name="p_alpha")
    rows = B.from_residual(rows, "log", "sin_mod", name="p_log")
    return B.from_residual(rows, "log", "sin_mod", bound=0.1, name="p_bounded")


@query("degree_days_o13", f"{SLOT}, hdd15:f6, hdd18:f6, cdd22:f6, temp_x_hour:f6, temp_x_weekend:f6, hdd_x_evening:f6", "O13",
       "SELECT community_code, datetime_utc, CASE WHEN t IS NOT NULL THEN greatest(0.0, 15 - t) END AS hdd15, CASE WHEN t IS NOT NULL THEN "
       "greatest(0.0, 18 - t) END AS hdd18, CASE WHEN t IS NOT NULL THEN greatest(0.0, t - 22) END AS cdd22, t * hour AS temp_x_hour, "
       "t * is_weekend AS temp_x_weekend, CASE WHEN t IS NOT NULL THEN greatest(0.0, 18 - t) * CASE WHEN hour BETWEEN 18 AND 23 THEN 1 "
       "ELSE 0 END END AS hdd_x_evening FROM (SELECT *, temperature_2m AS t FROM x)")
def _(spark, sf):
    return W.with_temp_interactions(W.with_degree_days(dataset(spark, sf)))


@query("log_context_o15", f"{SLOT}, log_clients:f6, log_dmw:f6, baseline_log:f6", "O15 F6",
       f"SELECT community_code, datetime_utc, ln({floor_at('n_clients_at_cutoff', '1')}) AS log_clients, ln({floor_at('D_mw', '1.0')}) AS "
       "log_dmw, ln(baseline_kw) AS baseline_log FROM train_rows")
def _(spark, sf):
    return B.with_log_context(B.training_rows(dataset(spark, sf)))


@query("training_rows_o11_p10", f"{SLOT}, baseline_kw:f4, total_pos:f2, y_log:f6", "O11 P10", "SELECT * FROM train_rows")
def _(spark, sf):
    return B.training_rows(dataset(spark, sf))


@query("holiday_typology_o17", f"{SLOT}, hol_type:s", "O17", f"SELECT community_code, datetime_utc, {HOL_TYPE} AS hol_type FROM base_d")
def _(spark, sf):
    return H.with_holiday_type(base_daily(spark, sf))


@query("holiday_type_of_any_date_o17", "o_orderkey:i, hol_type:s", "O17",
       f"SELECT o_orderkey, {HOL_TYPE} AS hol_type FROM (SELECT o_orderkey, 1 AS is_holiday, CAST(o_orderdate AS DATE) AS target_date FROM orders)")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.lit(1).alias("is_holiday"), F.to_date("o_orderdate").alias("target_date"))
    return H.with_holiday_type(orders)


@query("holiday_context_o18_o19_o20", f"{SLOT}, hol_type:s, hol_prev:i, hol_next:i, hol_2prev:i, hol_2next:i, is_bridge:i, "
       "days_since_hol:i, days_to_hol:i, hol_mismatch_7d:i", "O17 O18 O19 O20 J11",
       f"SELECT b.*, h.* EXCLUDE (community_code, target_date, is_holiday), {HOL_TYPE.replace('target_date', 'b.target_date').replace('is_holiday', 'b.is_holiday')} "
       "AS hol_type, CASE WHEN b.is_holiday <> h.hol_7d_ago THEN 1 ELSE 0 END AS hol_mismatch_7d FROM base_d b JOIN holiday_daily_d h "
       "ON h.community_code = b.community_code AND h.target_date = b.target_date")
def _(spark, sf):
    return H.with_holiday_context(base_daily(spark, sf))


@query("regional_holidays_o7", f"{SLOT}, target_date:d, is_holiday:i", "O7 S3",
       "SELECT x.* EXCLUDE (is_holiday), CASE WHEN h.date IS NOT NULL THEN 1 ELSE 0 END AS is_holiday FROM x LEFT JOIN regional_holidays h "
       "ON h.community_code = x.community_code AND h.date = x.target_date")
def _(spark, sf):
    m = Meter(spark, sf)
    return build_alpha_dataset(
        m.readings, m.demand, None, tables.load_holidays(spark, m.regional_holidays, regional=True), min_history_days=WEEK,
        unique_readings=True, regional_holidays=True)


@query("rolling_block_w9", f"{SLOT}, roll_mean_28d:f9, roll_std_28d:f9, same_dow_mean_28d:f9", "W9 O9",
       "SELECT x.community_code, x.datetime_utc, r.roll_mean_28d, r.roll_std_28d, (SELECT avg(v) FROM (VALUES (x.alpha_lag_7d), "
       "(x.alpha_lag_14d), (x.alpha_lag_21d), (x.alpha_lag_28d)) t(v)) AS same_dow_mean_28d FROM x LEFT JOIN (SELECT l.community_code, "
       "l.datetime_utc + INTERVAL '2' DAY AS datetime_utc, avg(h.alpha) AS roll_mean_28d, stddev_samp(h.alpha) AS roll_std_28d FROM base l "
       "JOIN base h ON h.community_code = l.community_code AND h.datetime_utc <= l.datetime_utc AND h.datetime_utc >= l.datetime_utc - "
       "INTERVAL '28' DAY GROUP BY 1, 2) r ON r.community_code = x.community_code AND r.datetime_utc = x.datetime_utc")
def _(spark, sf):
    m = Meter(spark, sf)
    return build_alpha_dataset(m.readings, m.demand, min_history_days=WEEK, unique_readings=True, rolling=True)


@query("holiday_mismatch_o20", f"{SLOT}, is_holiday:i, hol_7d_ago:i, hol_mismatch_7d:i", "O20 W6",
       "SELECT x.community_code, x.datetime_utc, x.is_holiday, h.hol_7d_ago, CASE WHEN x.is_holiday <> h.hol_7d_ago THEN 1 ELSE 0 END AS "
       "hol_mismatch_7d FROM x JOIN holiday_daily h ON h.community_code = x.community_code AND h.target_date = x.target_date")
def _(spark, sf):
    return H.holiday_mismatch(dataset(spark, sf))


@query("holiday_proximity_o19", f"{SLOT}, days_since_hol:i, days_to_hol:i", "O19 W7 W8",
       "SELECT x.community_code, x.datetime_utc, h.days_since_hol, h.days_to_hol FROM x JOIN holiday_daily h ON h.community_code = "
       "x.community_code AND h.target_date = x.target_date")
def _(spark, sf):
    return H.holiday_proximity(dataset(spark, sf))


_RICH = [c for c in features.RICH_FEATURES if c not in features.FEATURES]
_WHOLE = {"hour_of_week", "qhour_of_week", "hol_prev", "hol_next", "hol_2prev", "hol_2next", "is_bridge"}


@query("rich_features_o21", f"{SLOT}, baseline_kw:f4, y_log:f6, " + ", ".join(f"{c}:{'i' if c in _WHOLE else 'f6'}" for c in _RICH),
       "O21 O13 O14 O15 O18 O6c",
       f"SELECT r.*, h.* EXCLUDE (community_code, target_date, is_holiday), dow * 24 + hour AS hour_of_week, dow * 96 + mod AS qhour_of_week, "
       f"{_YEAR}, ln({floor_at('n_clients_at_cutoff', '1')}) AS log_clients, ln({floor_at('D_mw', '1.0')}) AS log_dmw, ln(baseline_kw) AS "
       "baseline_log, 24 * acos(greatest(-1.0, least(1.0, -tan(radians(40.0)) * tan(0.4093e0 * sin(2 * pi() * (doy - 81) / 365.25e0))))) "
       "/ pi() AS daylight_h, CASE WHEN t IS NOT NULL THEN greatest(0.0, 15 - t) END AS hdd15, CASE WHEN t IS NOT NULL THEN greatest(0.0, "
       "18 - t) END AS hdd18, CASE WHEN t IS NOT NULL THEN greatest(0.0, t - 22) END AS cdd22, t * hour AS temp_x_hour, t * is_weekend AS "
       "temp_x_weekend, CASE WHEN t IS NULL THEN NULL WHEN hour BETWEEN 18 AND 23 THEN greatest(0.0, 18 - t) ELSE 0 END AS hdd_x_evening "
       "FROM (SELECT *, temperature_2m AS t FROM train_rows) r JOIN holiday_daily_lagged h ON h.community_code = r.community_code "
       "AND h.target_date = r.target_date")
def _(spark, sf):
    return rich_features(dataset(spark, sf))


@query("compact_features_o21", f"{SLOT}, alpha_lag_median4:f9, baseline_log:f6, qhour_of_week:i, sin_doy_1:f6, cos_doy_1:f6, hol_type:s, "
       "hol_mismatch_7d:i, is_bridge:i, days_to_hol:i, days_since_hol:i, hdd18:f6, cdd22:f6", "O21 O16 O17 O19 O20",
       "SELECT r.community_code, r.datetime_utc, (SELECT median(v) FROM (VALUES (alpha_lag_7d), (alpha_lag_14d), (alpha_lag_21d), "
       "(alpha_lag_28d)) m(v)) AS alpha_lag_median4, ln(baseline_kw) AS baseline_log, dow * 96 + mod AS qhour_of_week, "
       "sin(2 * pi() * doy / 365.25e0) AS sin_doy_1, cos(2 * pi() * doy / 365.25e0) AS cos_doy_1, "
       f"{HOL_TYPE.replace('target_date', 'r.target_date').replace('is_holiday', 'r.is_holiday')} AS hol_type, "
       "CASE WHEN r.is_holiday <> h.hol_7d_ago THEN 1 ELSE 0 END AS hol_mismatch_7d, h.is_bridge, h.days_to_hol, h.days_since_hol, "
       "CASE WHEN t IS NOT NULL THEN greatest(0.0, 18 - t) END AS hdd18, CASE WHEN t IS NOT NULL THEN greatest(0.0, t - 22) END AS cdd22 "
       "FROM (SELECT *, temperature_2m AS t FROM train_rows) r JOIN holiday_daily_lagged h ON h.community_code = r.community_code "
       "AND h.target_date = r.target_date")
def _(spark, sf):
    return compact_features(dataset(spark, sf))


_COMPACT_NUM = [c for c in features.COMPACT_FEATURES if c not in features.COMPACT_CATEGORICAL]
# 672 week bins would force as many split candidates on every feature; the tree orders them as a number.
_COMPACT_NUM = ["qhour_of_week", *_COMPACT_NUM]
_COMPACT_CAT = [c for c in features.COMPACT_CATEGORICAL if c != "qhour_of_week"]


_MATRIX_NAMES = [*_COMPACT_NUM, *[f"{c}_missing" for c in _COMPACT_NUM], *_COMPACT_CAT]


@query("feature_matrix_o21", f"{SLOT}, width:i, missing:f2", "O21",
       f"SELECT community_code, datetime_utc, {len(_MATRIX_NAMES)} AS width, (sn_alpha_last IS NULL)::INT + (sn_alpha_mean_7d IS NULL)::INT + "
       "(baseline_kw IS NULL)::INT + 2 * (temperature_2m IS NULL)::INT AS missing FROM train_rows")
def _(spark, sf):
    rows = staged(compact_features(dataset(spark, sf)), "compact")
    matrix = M.fit_feature_matrix(rows, _COMPACT_NUM, _COMPACT_CAT)
    flags = [i + 1 for i, n in enumerate(matrix.names) if n.endswith("_missing")]
    vectors = M.feature_rows(matrix, rows, ["community_code", "datetime_utc"])
    return vectors.select("community_code", "datetime_utc", F.size("features").alias("width"),
                          sum(F.element_at("features", i) for i in flags).alias("missing"))


@query("holdout_split_o22", f"{SLOT}, target_date:d, split:s", "O22",
       "SELECT *, CASE WHEN target_date < DATE '2024-01-20' THEN 'train' ELSE 'valid' END AS split FROM x")
def _(spark, sf):
    return V.holdout(dataset(spark, sf), "2024-01-20")


@query("purged_fold_o22", f"{SLOT}, target_date:d, split:s", "O22",
       "SELECT *, CASE WHEN target_date < DATE '2024-01-13' THEN 'train' ELSE 'valid' END AS split FROM x WHERE target_date < "
       "DATE '2024-01-13' OR (target_date >= DATE '2024-01-20' AND target_date < DATE '2024-01-28')")
def _(spark, sf):
    return V.holdout(dataset(spark, sf), "2024-01-20", purge_days=7, end="2024-01-28")


@query("walk_forward_folds_o23", f"fold:i, role:s, {SLOT}", "O23", "SELECT fold, role, community_code, datetime_utc FROM placed")
def _(spark, sf):
    return V.assign_folds(B.training_rows(dataset(spark, sf)), FOLDS).filter(F.col("baseline_kw").isNotNull())


def _day_folds_sql(readings: str, splits: int, gap: int) -> str:
    return (f"SELECT k.fold, d.day AS target_date, d.i, k.cut, CASE WHEN d.i <= k.cut THEN 'train' WHEN d.i <= k.cut + k.size AND d.day >= "
            f"c.day + {gap} THEN 'valid' END AS role FROM (SELECT g AS fold, n - ({splits} - g) * (n // {splits + 1}) AS cut, n // {splits + 1} "
            f"AS size FROM (SELECT count(DISTINCT CAST(datetime_local AS DATE)) AS n FROM {readings}), range({splits}) t(g)) k JOIN "
            f"(SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT CAST(datetime_local AS DATE) AS day FROM {readings})) c "
            f"ON c.i = k.cut JOIN (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT CAST(datetime_local AS DATE) AS day "
            f"FROM {readings})) d ON d.i <= k.cut + k.size")


@query("day_folds_o24", "fold:i, role:s, target_date:d", "O24", f"SELECT * FROM ({_day_folds_sql('readings', 4, 2)}) WHERE role IS NOT NULL")
def _(spark, sf):
    days = Meter(spark, sf).readings.select(F.to_date("datetime_local").alias("target_date"))
    return V.day_folds(days, 4, 2)


@query("day_folds_over_years_o24", "fold:i, role:s, target_date:d", "O24",
       f"SELECT * FROM ({_day_folds_sql('readings_d', 5, 14)}) WHERE role IS NOT NULL")
def _(spark, sf):
    days = Daily(spark, sf).readings.select(F.to_date("datetime_local").alias("target_date"))
    return V.day_folds(days, 5, 14)


_SINGLE = ("2024-01-18", "2024-01-20", "2024-01-29")


def _single_sql(target: str, inverse: str) -> str:
    rows = (f"(SELECT *, {target} AS residual, CASE WHEN target_date < DATE '{_SINGLE[0]}' THEN 'train' WHEN target_date >= DATE "
            f"'{_SINGLE[1]}' AND target_date < DATE '{_SINGLE[2]}' THEN 'valid' END AS role FROM (SELECT *, alpha_lag_7d * "
            "n_clients_at_cutoff * D_mw AS baseline_kw FROM x WHERE alpha_lag_7d IS NOT NULL))")
    return f"SELECT *, {inverse} AS pred_kw FROM ({cell_median(rows, 'community_code', 'mod', 'residual', METER_MIN_ROWS)})"


_SCORED = f"{SLOT}, baseline_kw:f4, total_kw:f2, pred_kw:f4"


@query("residual_model_kw_o25", _SCORED, "O25 O11 O12", _single_sql("total_kw - baseline_kw", "baseline_kw + correction"))
def _(spark, sf):
    return evaluation.single_fold(dataset(spark, sf), *_SINGLE, kind="kw", min_rows=METER_MIN_ROWS)


@query("residual_model_share_o25", _SCORED, "O25 O11 O12",
       _single_sql("y - alpha_lag_7d", "(alpha_lag_7d + correction) * n_clients_at_cutoff * D_mw"))
def _(spark, sf):
    return evaluation.single_fold(dataset(spark, sf), *_SINGLE, kind="alpha", min_rows=METER_MIN_ROWS)


_OOF = f"fold:i, {SLOT}, baseline_kw:f4, total_kw:f2, pred_kw:f4"


@query("walk_forward_entity_o25", _OOF, "O25 O23 U1", "SELECT * FROM oof")
def _(spark, sf):
    return oof(spark, sf)


@query("walk_forward_pooled_o26", _OOF, "O26", "SELECT * FROM oof_pooled")
def _(spark, sf):
    return oof(spark, sf, pooled=True)


# Trees have no counterpart in SQL.  It states what must hold whatever they learn: the rows, what they are compared
# with, and that the learned factor stays within its bound.
_WITHIN = f"{_SCORED}"[:_SCORED.rindex(",")] + ", out_of_bound:i"
_OUT_OF_BOUND = "CASE WHEN pred_kw > baseline_kw * exp(0.5) + 1e-6 OR pred_kw < baseline_kw * exp(-0.5) - 1e-6 OR pred_kw IS NULL THEN 1 ELSE 0 END"


def _bounded(rows):
    far = (F.col("pred_kw") > F.col("baseline_kw") * F.exp(F.lit(0.5)) + 1e-6) | (
        F.col("pred_kw") < F.col("baseline_kw") * F.exp(F.lit(-0.5)) - 1e-6) | F.col("pred_kw").isNull()
    return rows.withColumn("out_of_bound", F.when(far, 1).otherwise(0))


_OOF_KEYS = f"SELECT fold, community_code, datetime_utc, baseline_kw, total_kw, {_OUT_OF_BOUND} AS out_of_bound FROM oof"


@query("boosted_pooled_o26", f"fold:i, {_WITHIN}", "O26", _OOF_KEYS)
def _(spark, sf):
    learner = M.Boosted(_COMPACT_NUM, _COMPACT_CAT, dict(weight="baseline_kw", min_instances=20))
    return _bounded(evaluation.walk_forward(
        compact_features(staged(dataset(spark, sf), "features")), FOLDS, pooled=True, learner=learner, prepared=True))


@query("boosted_rich_o26", f"fold:i, {_WITHIN}", "O26 O21", _OOF_KEYS)
def _(spark, sf):
    learner = M.Boosted(_ENTITY_NUM, ("community_code", *_ENTITY_CAT), dict(weight="baseline_kw", min_instances=20, trees=10))
    return _bounded(evaluation.walk_forward(
        rich_features(staged(dataset(spark, sf), "features")), FOLDS, pooled=True, learner=learner, prepared=True))


# Week bins are ordered, so trees take them as numbers; as categories they would force a split candidate for each bin.
_WEEK_BINS = ("hour_of_week", "qhour_of_week")
_ENTITY_CAT = [c for c in features.RICH_CATEGORICAL if c not in _WEEK_BINS]
_ENTITY_NUM = [c for c in features.RICH_FEATURES if c not in _ENTITY_CAT]


def _per_entity(spark, sf):
    # Written once: each entity's fit would otherwise rebuild the table.
    rows = staged(rich_features(staged(dataset(spark, sf), "features")).filter(F.col("baseline_kw").isNotNull()), "per-entity")
    train = rows.filter(F.col("target_date") < F.lit(FOLDS[-1][0]).cast("date"))
    models = M.fit_gbt_per_entity(
        train, "y_log", _ENTITY_NUM, _ENTITY_CAT, min_rows=METER_MIN_ROWS, weight="baseline_kw", min_instances=20)
    return rows, models


@query("boosted_per_entity_o25", _WITHIN, "O25",
       f"SELECT community_code, datetime_utc, baseline_kw, total_kw, {_OUT_OF_BOUND} AS out_of_bound FROM oof WHERE fold = {len(FOLDS) - 1}")
def _(spark, sf):
    rows, models = _per_entity(spark, sf)
    valid = rows.filter(F.col("target_date") >= F.lit(FOLDS[-1][1]).cast("date"))
    valid = valid.filter(F.col("target_date") < F.lit(FOLDS[-1][2]).cast("date"))
    return _bounded(B.from_residual(M.predict_per_entity(models, valid), "log", bound=0.5))


@query("feature_importance_o31", "feature:s, weight_sum:f6", "O31",
       f"SELECT unnest({_MATRIX_NAMES}) AS feature, 1.0 AS weight_sum")
def _(spark, sf):
    rows = compact_features(staged(dataset(spark, sf), "features")).filter(F.col("baseline_kw").isNotNull())
    found = M.fit_gbt(rows, "y_log", _COMPACT_NUM, _COMPACT_CAT, weight="baseline_kw", min_instances=20).importance(spark)
    return found.crossJoin(found.agg(F.sum("weight").alias("weight_sum")))


@query("top_features_o31_t5", "community_code:s, rank:i, share_ok:i", "O31 T5 W11",
       f"SELECT community_code, rank, 1 AS share_ok FROM (SELECT DISTINCT community_code FROM oof WHERE fold = {len(FOLDS) - 1}) "
       "CROSS JOIN range(1, 6) r(rank)")
def _(spark, sf):
    _, models = _per_entity(spark, sf)
    top = M.top_features(M.importance_table(spark, models), 5)
    return top.withColumn("share_ok", F.when(F.col("share").between(0, 1), 1).otherwise(0))




@query("blend_sweep_o27", "weight:f2, mae_kw:f4", "O27 J12",
       "SELECT weight, avg(abs(actual - pred)) AS mae_kw FROM (SELECT w.weight, a.fold, a.datetime_utc, sum(a.total_kw) AS actual, "
       "sum(w.weight * a.pred_kw + (1 - w.weight) * b.pred_kw) AS pred FROM oof a JOIN oof_pooled b USING (fold, community_code, "
       f"datetime_utc) CROSS JOIN (SELECT unnest({list(M.BLEND_WEIGHTS)})::DOUBLE AS weight) w GROUP BY 1, 2, 3) GROUP BY weight")
def _(spark, sf):
    rows = staged(dataset(spark, sf), "features")
    own = evaluation.walk_forward(rows, FOLDS, False, METER_MIN_ROWS)
    pooled = evaluation.walk_forward(rows, FOLDS, True, METER_MIN_ROWS)
    return M.blend_sweep(own, pooled)


@query("portfolio_forecast_o28", "datetime_utc:t, prediction:f4", "O28 P12 A13",
       f"SELECT datetime_utc, sum(COALESCE(baseline_kw, 0) + COALESCE(correction, 0)) AS prediction FROM "
       f"({cell_median('''(SELECT *, total_kw - baseline_kw AS residual, CASE WHEN target_date < DATE '2024-01-20' THEN 'train' ELSE 'valid' END AS role FROM (SELECT *, alpha_lag_7d * n_clients_at_cutoff * D_mw AS baseline_kw FROM x))''', 'community_code', 'mod', 'residual', METER_MIN_ROWS)}) GROUP BY 1")
def _(spark, sf):
    rows = V.holdout(B.with_residual(B.with_baseline(dataset(spark, sf)), "kw"), "2024-01-20")
    model = M.fit_cell_median(rows.filter(F.col("split") == "train"), min_rows=METER_MIN_ROWS)
    return B.portfolio_forecast(model.predict(rows.filter(F.col("split") == "valid")))


def _score_sql(start: str, end: str) -> str:
    rows = (f"(SELECT *, hour(datetime_local) * 4 + minute(datetime_local) // 15 AS qhour, isodow(datetime_local) - 1 AS dow, CASE WHEN "
            f"datetime_local < TIMESTAMP '{start}' THEN 'train' WHEN datetime_local < TIMESTAMP '{end}' THEN 'valid' END AS role FROM "
            f"({_baseline_d2(_entity_base(_apart(10, start)))}))")
    return ("SELECT datetime_local AS datetime_15min, sum(COALESCE(baseline_kw, 0) + COALESCE(correction, 0)) AS prediction FROM "
            f"({cell_median(rows, 'community_code', 'qhour', 'residual', METER_MIN_ROWS)}) GROUP BY 1")


@query("score_horizon_o29", "datetime_15min:t, prediction:f4", "O29 O2 O10b O28", _score_sql("2024-01-22", "2024-01-29"))
def _(spark, sf):
    m = Meter(spark, sf)
    return evaluation.score(
        m.readings, m.demand, "2024-01-22", "2024-01-29", m.weather, top_n=10, min_rows=METER_MIN_ROWS,
        unique_readings=True)


def _cv_sql(splits: int, gap: int, top_n: int, min_rows: int) -> str:
    folds = f"SELECT fold, target_date, role FROM ({_day_folds_sql('readings', splits, gap)}) WHERE role IS NOT NULL"
    big = ("SELECT fold, client_id FROM (SELECT f.fold, r.client_id, row_number() OVER (PARTITION BY f.fold ORDER BY sum(r.active_kw) DESC "
           "NULLS LAST, r.client_id) AS k FROM readings r JOIN fd f ON f.target_date = CAST(r.datetime_local AS DATE) AND f.role = 'train' "
           f"GROUP BY 1, 2) WHERE k <= {top_n}")
    entity = ("SELECT g.fold, COALESCE('BIG_' || b.client_id, r.community_code) AS community_code, r.client_id, r.datetime_utc, "
              f"r.datetime_local, r.active_kw FROM readings r CROSS JOIN range({splits}) g(fold) LEFT JOIN bg b ON b.fold = g.fold "
              "AND b.client_id = r.client_id")
    panel = (f"SELECT p.*, d.value AS D_mw, {share('p.total_kw', 'p.n_clients', 'd.value')} AS alpha, CAST(p.datetime_local AS DATE) AS "
             "target_date FROM (SELECT fold, community_code, datetime_utc, min(datetime_local) AS datetime_local, sum(active_kw) AS "
             f"total_kw, count(DISTINCT client_id) AS n_clients FROM ({entity}) GROUP BY 1, 2, 3) p LEFT JOIN demand d ON d.datetime_utc = "
             "date_trunc('hour', p.datetime_utc)")
    rows = (f"(SELECT q.*, f.role, hour(q.datetime_local) * 4 + minute(q.datetime_local) // 15 AS qhour, isodow(q.datetime_local) - 1 AS dow "
            f"FROM ({_baseline_d2(panel, 'fold, community_code')}) q JOIN fd f ON f.fold = q.fold AND f.target_date = q.target_date)")
    slots = ("SELECT fold, datetime_utc, sum(total_kw) AS actual, sum(COALESCE(baseline_kw, 0) + correction) AS pred FROM "
             f"({cell_median(rows, 'fold, community_code', 'qhour', 'residual', min_rows)}) GROUP BY 1, 2")
    return (f"WITH fd AS MATERIALIZED ({folds}), bg AS MATERIALIZED ({big}) SELECT e.*, m.mae_kw, m.n_points FROM (SELECT fold, "
            "min(target_date) FILTER (role = 'train') AS train_start, max(target_date) FILTER (role = 'train') AS train_end, "
            "min(target_date) FILTER (role = 'valid') AS valid_start, max(target_date) FILTER (role = 'valid') AS valid_end FROM fd GROUP BY 1) e "
            f"JOIN (SELECT fold, avg(abs(actual - pred)) AS mae_kw, count(*) AS n_points FROM ({slots}) GROUP BY 1) m USING (fold)")


_TREES = dict(min_instances=20)


@query("score_boosted_o29", "datetime_15min:t, known:i", "O29 O26",
       f"SELECT datetime_15min, 1 AS known FROM ({_score_sql('2024-01-22', '2024-01-29')})")
def _(spark, sf):
    """Trees over baseline, calendar and weather in place of cell medians."""
    m = Meter(spark, sf)
    out = evaluation.score(
        m.readings, m.demand, "2024-01-22", "2024-01-29", m.weather, top_n=10, unique_readings=True,
        learner=M.Boosted(evaluation.SCORING_FEATURES, options=_TREES))
    return out.withColumn("known", F.when(F.col("prediction").isNotNull(), 1).otherwise(0))


@query("cross_validation_raw_o30", "fold:i, train_start:d, train_end:d, valid_start:d, valid_end:d, mae_kw:f4, n_points:i", "O30 A2",
       _cv_sql(3, 2, 10, METER_MIN_ROWS).replace("readings", "raw_readings"))
def _(spark, sf):
    """Over events as they are, with several readings of a client in a slot."""
    m = Meter(spark, sf)
    return evaluation.cross_validate(
        m.raw_readings, m.demand, n_splits=3, gap_days=2, top_n=10, min_rows=METER_MIN_ROWS, unique_readings=False)


@query("cross_validation_boosted_o30", "fold:i, train_start:d, train_end:d, valid_start:d, valid_end:d, n_points:i", "O30 O26",
       f"SELECT fold, train_start, train_end, valid_start, valid_end, n_points FROM ({_cv_sql(3, 2, 10, METER_MIN_ROWS)})")
def _(spark, sf):
    m = Meter(spark, sf)
    return evaluation.cross_validate(
        m.readings, m.demand, n_splits=3, gap_days=2, top_n=10, unique_readings=True, weather=m.weather,
        learner=M.Boosted(evaluation.SCORING_FEATURES, options=_TREES))


@query("cross_validation_o30", "fold:i, train_start:d, train_end:d, valid_start:d, valid_end:d, mae_kw:f4, n_points:i", "O30 O24 O2 A14",
       _cv_sql(3, 2, 10, METER_MIN_ROWS))
def _(spark, sf):
    m = Meter(spark, sf)
    return evaluation.cross_validate(
        m.readings, m.demand, n_splits=3, gap_days=2, top_n=10, min_rows=METER_MIN_ROWS, unique_readings=True)


@query("baseline_portfolio_error_o10_a14", "datetime_utc:t, actual:f2, pred:f4, abs_error:f4", "O10 A13 A14",
       "SELECT *, abs(actual - pred) AS abs_error FROM (SELECT datetime_utc, sum(total_kw) AS actual, sum(alpha_lag_7d * "
       "n_clients_at_cutoff * D_mw) AS pred FROM x WHERE alpha_lag_7d IS NOT NULL GROUP BY 1)")
def _(spark, sf):
    return flagship(spark, sf)


def flagship(spark, sf):
    """Weekly-share baseline of the whole portfolio against what was metered, per slot."""
    rows = B.with_baseline(dataset(spark, sf).dropna(subset=["alpha_lag_7d"]))
    slots = B.portfolio(rows, {"actual": "total_kw", "pred": "baseline_kw"})
    return slots.withColumn("abs_error", F.abs(F.col("actual") - F.col("pred")))
