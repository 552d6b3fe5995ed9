"""Scans, writers, projections and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattshare import features, schemas
from wattshare.catalog.base import query
from wattshare.catalog.shared import base, dataset, panel
from wattshare.catalog.sql import CLOCK, FOLDS, floor_at
from wattshare.functions.rowwise import clip, flag, ratio
from wattshare.functions.timegrid import is_clock
from wattshare.operators.alpha import with_alpha, with_demand
from wattshare.operators.baseline import portfolio_forecast, with_baseline, with_baseline_d2, with_residual
from wattshare.operators.calendar import with_calendar
from wattshare.operators.model import fit_cell_median
from wattshare.operators.panel import reclassify_large_clients
from wattshare.operators.validation import assign_fold_table
from wattshare.operators.weather import attach_weather
from wattshare.session import shared_dir
from wattshare.sources import tables
from wattshare.sources.fixtures import Meter

READING = "client_id:s, community_code:s, datetime_utc:t, datetime_local:t, active_kw:f2"
SLOT = "community_code:s, datetime_utc:t"


def _scratch(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _stored(spark, df, label):
    """Write a table and return where it went, so that a loader can be tried on a stored table."""
    path = _scratch(spark, label)
    df.write.parquet(path)
    return path


@query("readings_scan_s1", READING, "S1", "SELECT * FROM readings")
def _(spark, sf):
    return tables.load_readings(spark, Meter(spark, sf).readings)


@query("demand_scan_s2", "datetime_utc:t, D_mw:f4", "S2", "SELECT datetime_utc, value AS D_mw FROM demand")
def _(spark, sf):
    stored = _stored(spark, Meter(spark, sf).demand, "demand")
    return tables.demand_as_mw(tables.load_hourly_forecast(spark, stored))


@query("holiday_scan_s3", "date:d", "S3", "SELECT DISTINCT date FROM holidays")
def _(spark, sf):
    return tables.load_holidays(spark, _stored(spark, Meter(spark, sf).holidays, "holidays"))


_WEATHER_COLUMNS = "community_code:s, datetime_local:t, " + ", ".join(
    f"{m}:{'i' if m == 'is_day' else 'f6'}" for m in schemas.WEATHER_MEASURES)


@query("weather_scan_s4_p13", _WEATHER_COLUMNS, "S4 P3 P13", "SELECT * FROM weather1")
def _(spark, sf):
    return tables.normalise_weather(tables.load_weather(spark, _stored(spark, Meter(spark, sf).weather, "weather")))


@query("generation_scan_s5", "datetime_utc:t, value:f2", "S5", "SELECT * FROM generation")
def _(spark, sf):
    return tables.load_hourly_forecast(spark, _stored(spark, Meter(spark, sf).generation, "generation"))


def feature_columns(lags=features.LAGS) -> str:
    whole = {"n_clients_at_cutoff", "hour", "qhour", "mod", "dow", "month", "doy", "is_weekend", "is_holiday", "is_day"}
    kinds = {"community_code": "s", "target_date": "d", "datetime_utc": "t", "datetime_local": "t",
             "total_kw": "f2", "n_clients": "i", "y": "f9"}
    cols = features.BOOKKEEPING + ["y"] + [c for c in features.FEATURES if c not in features.LAGS or c in lags]
    def kind(c):
        return kinds.get(c) or ("i" if c in whole else "f9" if "alpha" in c else "f6")
    return ", ".join(f"{c}:{kind(c)}" for c in cols)


@query("feature_table_s6", feature_columns(), "S6", "SELECT * FROM x")
def _(spark, sf):
    target = _scratch(spark, "features")
    tables.save_features(dataset(spark, sf), target)
    return tables.load_features(spark, target)


@query("prediction_sink_s7", "team_name:s, datetime_15min:t, prediction:f4, stamped:i", "S7 F11",
       "SELECT 'wattshare' AS team_name, datetime_local AS datetime_15min, "
       "sum(COALESCE(alpha_lag_7d * n_clients_at_cutoff * D_mw, 0)) AS prediction, 1 AS stamped FROM x GROUP BY datetime_local")
def _(spark, sf):
    rows = with_baseline(dataset(spark, sf)).withColumn("correction", F.lit(None).cast("double"))
    out = portfolio_forecast(rows, ["datetime_local"]).withColumnRenamed("datetime_local", "datetime_15min")
    target = _scratch(spark, "predictions")
    tables.save_predictions(out, target, "wattshare")
    return spark.read.parquet(target).withColumn("stamped", flag(F.col("submitted_at").isNotNull()))


@query("fold_rows_table_s9", "fold:i, community_code:s, n_rows:i", "S9 J16",
       "SELECT f.fold, b.community_code, count(*) AS n_rows FROM base b JOIN folds f "
       "ON b.target_date >= f.valid_start AND b.target_date < f.valid_end GROUP BY 1, 2")
def _(spark, sf):
    rows = [(i, *f) for i, f in enumerate(FOLDS)]
    folds = tables.rows_as_table(spark, rows, "fold int, train_end string, valid_start string, valid_end string")
    folds = folds.select("fold", *[F.col(c).cast("date").alias(c) for c in ("train_end", "valid_start", "valid_end")])
    return assign_fold_table(base(spark, sf), folds, valid_only=True).groupBy("fold", "community_code").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("project_alias_p1", "community:s, slot_utc:t, load_kw:f2, clients:i", "P1",
       "SELECT community_code AS community, datetime_utc AS slot_utc, total_kw AS load_kw, n_clients AS clients FROM panel")
def _(spark, sf):
    return panel(spark, sf).select(
        F.col("community_code").alias("community"), F.col("datetime_utc").alias("slot_utc"),
        F.col("total_kw").alias("load_kw"), F.col("n_clients").alias("clients"))


@query("derived_columns_p2", f"{SLOT}, hour:i, qhour:i, mod:i, dow:i, month:i, doy:i, is_weekend:i, sin_mod:f6, cos_mod:f6",
       "P2 F2", f"SELECT community_code, datetime_utc, {CLOCK} FROM panel")
def _(spark, sf):
    return with_calendar(panel(spark, sf))


@query("drop_rename_p3", f"{SLOT}, load_kw:f2, n_clients:i", "P3",
       "SELECT community_code, datetime_utc, total_kw AS load_kw, n_clients FROM panel")
def _(spark, sf):
    return panel(spark, sf).drop("mean_kw", "median_kw", "std_kw").withColumnRenamed("total_kw", "load_kw")


@query("case_expression_p4", f"{SLOT}, size_class:s", "P4",
       "SELECT community_code, datetime_utc, CASE WHEN n_reporting = 0 THEN 'silent' WHEN n_clients = 1 THEN 'single' "
       "ELSE 'group' END AS size_class FROM panel")
def _(spark, sf):
    label = F.when(F.col("n_reporting") == 0, "silent").when(F.col("n_clients") == 1, "single").otherwise("group")
    return panel(spark, sf).withColumn("size_class", label)


@query("flag_cast_p5", "client_id:s, datetime_utc:t, community_code:s, is_missing:i, above_100:i", "P5",
       "SELECT client_id, datetime_utc, community_code, CASE WHEN active_kw IS NULL THEN 1 ELSE 0 END AS is_missing, "
       "CASE WHEN active_kw > 100 THEN 1 ELSE 0 END AS above_100 FROM readings")
def _(spark, sf):
    return Meter(spark, sf).readings.select(
        "client_id", "datetime_utc", "community_code", F.col("active_kw").isNull().cast("int").alias("is_missing"),
        flag(F.col("active_kw") > 100).alias("above_100"))


@query("conjunction_filter_p6", READING, "P6",
       "SELECT * FROM readings WHERE community_code = 'view' AND active_kw IS NULL")
def _(spark, sf):
    return Meter(spark, sf).readings.filter((F.col("community_code") == "view") & F.col("active_kw").isNull())


@query("clock_filter_p7", f"{SLOT}, datetime_local:t, alpha:f9", "P7",
       "SELECT * FROM base WHERE hour(datetime_local) = 11 AND minute(datetime_local) = 45")
def _(spark, sf):
    return base(spark, sf).filter(is_clock("datetime_local", 11, 45))


@query("date_range_filter_p8", f"{SLOT}, target_date:d, total_kw:f2", "P8",
       "SELECT * FROM base WHERE target_date >= DATE '2024-01-10' AND target_date < DATE '2024-01-20'")
def _(spark, sf):
    return tables.between_dates(base(spark, sf), "target_date", "2024-01-10", "2024-01-20")


@query("membership_filter_p9", f"{SLOT}, dow:i", "P9",
       "SELECT community_code, datetime_utc, dayofweek(datetime_local) + 1 AS dow FROM panel "
       "WHERE dayofweek(datetime_local) IN (0, 6)")
def _(spark, sf):
    return panel(spark, sf).withColumn("dow", F.dayofweek("datetime_local")).filter(F.col("dow").isin(1, 7))


@query("membership_semi_join_p9", f"{SLOT}, target_date:d, total_kw:f2", "P9",
       "SELECT * FROM base WHERE target_date IN (SELECT date FROM holidays)")
def _(spark, sf):
    listed = tables.distinct_dates(Meter(spark, sf).holidays).withColumnRenamed("date", "target_date")
    return base(spark, sf).join(listed, "target_date", "left_semi")


@query("null_filter_p10", f"{SLOT}, alpha:f9", "P10", "SELECT * FROM base WHERE alpha IS NOT NULL AND std_kw IS NOT NULL")
def _(spark, sf):
    return with_alpha(panel(spark, sf), Meter(spark, sf).demand).dropna(subset=["alpha", "std_kw"])


@query("clip_p11", f"{SLOT}, low:f2, high:f2, bounded:f2", "P11 F7",
       f"SELECT community_code, datetime_utc, {floor_at('total_kw', '10.0')} AS low, "
       "CASE WHEN total_kw IS NOT NULL THEN least(total_kw, 60.0) END AS high, "
       "CASE WHEN total_kw IS NOT NULL THEN least(greatest(total_kw, 10.0), 60.0) END AS bounded FROM panel")
def _(spark, sf):
    return panel(spark, sf).withColumns({
        "low": clip("total_kw", lower=10.0), "high": clip("total_kw", upper=60.0), "bounded": clip("total_kw", 10.0, 60.0)})


@query("fill_nulls_p12", f"{SLOT}, total_kw:f2, std_kw:f6", "P12",
       "SELECT community_code, datetime_utc, COALESCE(total_kw, 0) AS total_kw, COALESCE(std_kw, 0) AS std_kw FROM panel")
def _(spark, sf):
    return panel(spark, sf).fillna(0.0, subset=["total_kw", "std_kw"])


@query("bernoulli_sample_p14", f"{SLOT}, total_kw:f2", "P14",
       "SELECT * FROM panel WHERE substr(md5(community_code || '|' || strftime(datetime_utc, '%Y-%m-%d %H:%M:%S')), 1, 8) < '0ccccccd'")
def _(spark, sf):
    return tables.hash_sample(panel(spark, sf), ["community_code", "datetime_utc"], 0.05)


@query("optional_columns_p15", f"{SLOT}, temperature_2m:f6, is_day:i", "P15 P4 J4",
       "SELECT p.community_code, p.datetime_utc, w.temperature_2m, w.is_day FROM panel p LEFT JOIN weather1 w "
       "ON w.community_code = p.community_code AND w.datetime_local = p.datetime_local")
def _(spark, sf):
    m = Meter(spark, sf)
    narrow = m.weather.select("community_code", "province", "time", "temperature_2m", "is_day")
    return attach_weather(panel(spark, sf), narrow)


@query("guarded_division_p16", f"{SLOT}, per_mw:f9, per_reporting:f6", "P16",
       "SELECT community_code, datetime_utc, CASE WHEN D_mw > 0 THEN total_kw / D_mw END AS per_mw, "
       "CASE WHEN n_reporting > 0 THEN total_kw / n_reporting END AS per_reporting FROM base")
def _(spark, sf):
    return with_demand(panel(spark, sf), Meter(spark, sf).demand).withColumns({
        "per_mw": ratio("total_kw", "D_mw"), "per_reporting": ratio("total_kw", "n_reporting")})


@query("cell_residual_by_slot_p12_o25", "community_code:s, qhour:i, coarse:f4", "P12 O25",
       "SELECT community_code, hour(datetime_local) * 4 + minute(datetime_local) // 15 AS qhour, "
       "median(alpha_d) AS coarse FROM (SELECT b.*, b.total_kw - l7.alpha * l2.n_clients * b.D_mw AS alpha_d "
       "FROM base b JOIN base l7 ON l7.community_code = b.community_code AND l7.datetime_utc = b.datetime_utc - INTERVAL '7' DAY "
       "JOIN base l2 ON l2.community_code = b.community_code AND l2.datetime_utc = b.datetime_utc - INTERVAL '2' DAY) "
       "WHERE alpha_d IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    rows = with_calendar(with_residual(with_baseline_d2(base(spark, sf)), "kw"), "cyclic")
    return fit_cell_median(rows, "residual", slot="qhour").table


@query("entity_rename_f8", "client_id:s, community_code:s, n_rows:i", "F8 P9",
       "SELECT r.client_id, CASE WHEN t.client_id IS NOT NULL THEN 'BIG_' || r.client_id ELSE r.community_code END AS "
       "community_code, count(*) AS n_rows FROM readings r LEFT JOIN (SELECT client_id FROM readings GROUP BY 1 "
       "ORDER BY sum(active_kw) DESC NULLS LAST, client_id LIMIT 10) t ON t.client_id = r.client_id GROUP BY 1, 2")
def _(spark, sf):
    return reclassify_large_clients(Meter(spark, sf).readings, 10).groupBy("client_id", "community_code").agg(
        F.count(F.lit(1)).alias("n_rows"))
