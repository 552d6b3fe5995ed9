"""Joins, windows, sorting, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattshare.catalog.base import query
from wattshare.catalog.shared import WEEK, base, base_daily, dataset, oof, panel
from wattshare.catalog.sql import FOLDS, METER_MIN_ROWS, floor_at
from wattshare.functions.rowwise import safe_log
from wattshare.functions.timegrid import days_later, epoch_seconds, hour_start, second_of_day, slot_start
from wattshare.operators import alpha as A
from wattshare.operators import diagnostics, holidays, quality
from wattshare.operators.panel import client_energy, null_rate, reclassify_large_clients, top_clients, with_new_flag
from wattshare.operators.quantiles import exact_quantiles
from wattshare.operators.validation import assign_folds
from wattshare.operators.weather import attach_weather
from wattshare.plans.dataset import first_date, history_filter
from wattshare.plans.evaluation import walk_forward
from wattshare.session import staged
from wattshare.sources.fixtures import Daily, Meter

SLOT = "community_code:s, datetime_utc:t"
DAY_SECONDS = 86_400


@query("first_seen_join_j1", "client_id:s, community_code:s, datetime_utc:t, is_new:i, is_missing:i", "J1 P5",
       "SELECT r.client_id, r.community_code, r.datetime_utc, CASE WHEN r.datetime_utc = f.first_utc THEN 1 ELSE 0 END AS "
       "is_new, CASE WHEN r.active_kw IS NULL THEN 1 ELSE 0 END AS is_missing FROM readings r JOIN first_seen f USING (client_id)")
def _(spark, sf):
    return with_new_flag(Meter(spark, sf).readings)


@query("demand_join_hour_j2", f"{SLOT}, D_mw:f4", "J2 F1",
       "SELECT p.community_code, p.datetime_utc, d.value AS D_mw FROM panel p LEFT JOIN demand d "
       "ON d.datetime_utc = date_trunc('hour', p.datetime_utc)")
def _(spark, sf):
    return A.with_demand(panel(spark, sf), Meter(spark, sf).demand)


@query("demand_join_exact_j3", f"{SLOT}, D_mw:f4", "J3",
       "SELECT p.community_code, p.datetime_utc, d.value AS D_mw FROM panel p LEFT JOIN demand d USING (datetime_utc)")
def _(spark, sf):
    return A.with_demand(panel(spark, sf), Meter(spark, sf).demand, exact=True)


@query("weather_join_j4", f"{SLOT}, temperature_2m:f6, precipitation:f6, shortwave_radiation:f6, is_day:i", "J4",
       "SELECT p.community_code, p.datetime_utc, w.temperature_2m, w.precipitation, w.shortwave_radiation, w.is_day "
       "FROM panel p LEFT JOIN weather1 w ON w.community_code = p.community_code AND w.datetime_local = p.datetime_local")
def _(spark, sf):
    return attach_weather(panel(spark, sf), Meter(spark, sf).weather)


@query("holiday_join_j5_o7", f"{SLOT}, target_date:d, is_holiday:i", "J5 O7",
       "SELECT *, CASE WHEN target_date IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday FROM base")
def _(spark, sf):
    return holidays.with_holiday_flag(base(spark, sf), Meter(spark, sf).holidays)


_LAG_COLUMNS = f"{SLOT}, alpha_lag_2d:f9, alpha_lag_7d:f9, alpha_lag_14d:f9, alpha_lag_21d:f9, alpha_lag_28d:f9"


@query("time_shifted_self_join_j6", _LAG_COLUMNS, "J6", "SELECT * FROM lagged")
def _(spark, sf):
    rows = base(spark, sf, stage=True)
    for n in (2, 7, 14, 21, 28):
        rows = A.with_lag_join(rows, "alpha", n, f"alpha_lag_{n}d")
    return rows


@query("point_frame_lags_w1x", _LAG_COLUMNS, "W1x J6 J17", "SELECT * FROM lagged")
def _(spark, sf):
    return A.with_alpha_lags(base(spark, sf))


@query("snapshot_join_j7", f"{SLOT}, target_date:d, n_clients_at_cutoff:i, sn_alpha_last:f9", "J7",
       "SELECT b.community_code, b.datetime_utc, b.target_date, s.n_clients_at_cutoff, s.sn_alpha_last FROM base b "
       "LEFT JOIN snapshot s USING (community_code, target_date)")
def _(spark, sf):
    rows = base(spark, sf)
    return A.attach_snapshot(rows, A.cutoff_snapshot(rows))


@query("first_date_join_j8_o8", f"{SLOT}, target_date:d, age_days:i", "J8 O8",
       "SELECT b.community_code, b.datetime_utc, b.target_date, b.target_date - f.first_date AS age_days FROM base b "
       "JOIN first_dates f USING (community_code) WHERE b.target_date - f.first_date >= 7 AND b.alpha IS NOT NULL")
def _(spark, sf):
    rows = base(spark, sf)
    firsts = first_date(rows)
    aged = rows.join(firsts, "community_code").withColumn("age_days", F.datediff("target_date", "first_date"))
    return history_filter(aged.drop("first_date"), WEEK, firsts, "alpha")


@query("large_client_join_j9", "community_code:s, n_rows:i, total_kw:f2", "J9",
       "WITH big AS (SELECT client_id FROM readings GROUP BY 1 ORDER BY sum(active_kw) DESC NULLS LAST, client_id LIMIT 30) "
       "SELECT COALESCE('BIG_' || b.client_id, r.community_code) AS community_code, count(*) AS n_rows, "
       "sum(r.active_kw) AS total_kw FROM readings r LEFT JOIN big b ON b.client_id = r.client_id GROUP BY 1")
def _(spark, sf):
    return reclassify_large_clients(Meter(spark, sf).readings, 30).groupBy("community_code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("active_kw").alias("total_kw"))


_GRID = """SELECT community_code, unnest(generate_series(min(datetime_utc), max(datetime_utc), INTERVAL 15 MINUTE))
  AS datetime_utc FROM panel GROUP BY community_code"""


@query("grid_gaps_j10_q8", SLOT, "J10 F4 Q8",
       f"SELECT g.* FROM ({_GRID}) g ANTI JOIN panel p ON p.community_code = g.community_code AND p.datetime_utc = g.datetime_utc")
def _(spark, sf):
    return quality.grid_gaps(panel(spark, sf))


@query("holiday_days_join_j11", f"{SLOT}, hol_prev:i, hol_next:i, is_bridge:i", "J11 O18",
       "SELECT x.community_code, x.datetime_utc, h.hol_prev, h.hol_next, h.is_bridge FROM x JOIN holiday_daily h "
       "ON h.community_code = x.community_code AND h.target_date = x.target_date")
def _(spark, sf):
    return holidays.holiday_neighbours(dataset(spark, sf))


@query("oof_inner_join_j12", f"fold:i, {SLOT}, p_entity:f4, p_pooled:f4", "J12",
       "SELECT a.fold, a.community_code, a.datetime_utc, a.pred_kw AS p_entity, b.pred_kw AS p_pooled FROM oof a "
       "JOIN oof_pooled b USING (fold, community_code, datetime_utc)")
def _(spark, sf):
    rows = staged(dataset(spark, sf), "features")
    keys = ["fold", "community_code", "datetime_utc"]
    own = walk_forward(rows, FOLDS, False, METER_MIN_ROWS).select(*keys, F.col("pred_kw").alias("p_entity"))
    pooled = walk_forward(rows, FOLDS, True, METER_MIN_ROWS).select(*keys, F.col("pred_kw").alias("p_pooled"))
    return own.join(pooled, keys)


@query("predicted_actual_join_j13", "datetime_utc:t, y_true:f2, y_hat:f4", "J13",
       "SELECT o.datetime_utc, r.y_true, o.y_hat FROM (SELECT datetime_utc, sum(pred_kw) AS y_hat FROM oof GROUP BY 1) o "
       "JOIN (SELECT datetime_utc, sum(active_kw) AS y_true FROM readings GROUP BY 1) r USING (datetime_utc)")
def _(spark, sf):
    predicted = oof(spark, sf).groupBy("datetime_utc").agg(F.sum("pred_kw").alias("y_hat"))
    actual = Meter(spark, sf).readings.groupBy("datetime_utc").agg(F.sum("active_kw").alias("y_true"))
    return predicted.join(actual, "datetime_utc")


@query("first_dates_join_j14", "community_code:s, min_age:i, n_rows:i", "J14 Q7",
       "SELECT x.community_code, min(x.target_date - f.first_date) AS min_age, count(*) AS n_rows FROM x "
       "JOIN first_dates f USING (community_code) GROUP BY 1")
def _(spark, sf):
    firsts = Meter(spark, sf).readings.groupBy("community_code").agg(
        F.min(F.to_date("datetime_local")).alias("first_date"))
    return dataset(spark, sf).join(firsts, "community_code").groupBy("community_code").agg(
        F.min(F.datediff("target_date", "first_date")).alias("min_age"), F.count(F.lit(1)).alias("n_rows"))


@query("holiday_lookup_j15", f"{SLOT}, total_kw:f2, is_hol:i", "J15",
       "SELECT community_code, datetime_utc, total_kw, CASE WHEN CAST(datetime_utc AS DATE) IN (SELECT target_date FROM base_d "
       "WHERE is_holiday = 1) THEN 1 ELSE 0 END AS is_hol FROM base_d")
def _(spark, sf):
    rows = base_daily(spark, sf)
    flags = rows.groupBy(F.col("target_date").alias("_d")).agg(F.max("is_holiday").alias("h"))
    return rows.join(flags, F.to_date("datetime_utc") == F.col("_d"), "left").withColumn(
        "is_hol", F.coalesce("h", F.lit(0)))


@query("fold_assignment_j16_o23", f"fold:i, role:s, {SLOT}", "J16 O23",
       "SELECT f.fold, CASE WHEN b.target_date < f.train_end THEN 'train' ELSE 'valid' END AS role, b.community_code, "
       "b.datetime_utc FROM base b JOIN folds f ON b.target_date < f.train_end OR (b.target_date >= f.valid_start "
       "AND b.target_date < f.valid_end)")
def _(spark, sf):
    return assign_folds(base(spark, sf), FOLDS)


@query("lookup_back_j17_q3", "rule:s, violations:i", "J17 Q3",
       " UNION ALL ".join(
           f"SELECT 'alpha_lag_{n}d' AS rule, count(*) FILTER (abs(l.alpha_lag_{n}d - b.alpha) > 1e-6 OR (l.alpha_lag_{n}d IS NULL) <> (b.alpha "
           f"IS NULL)) AS violations FROM lagged l LEFT JOIN base b ON b.community_code = l.community_code AND b.datetime_utc = l.datetime_utc "
           f"- INTERVAL '{n}' DAY" for n in (2, 7, 14, 21, 28)))
def _(spark, sf):
    rows = base(spark, sf, stage=True)
    days = (2, 7, 14, 21, 28)
    return quality.check_lags(A.with_alpha_lags(rows, days), rows, days)


_TRAILING = """SELECT b.community_code, b.datetime_utc,
  avg(h.alpha) FILTER (h.datetime_utc > b.datetime_utc - INTERVAL '24' HOUR) AS mean_24h,
  avg(h.alpha) AS mean_7d, stddev_samp(h.alpha) AS std_7d
FROM base b LEFT JOIN base h ON h.community_code = b.community_code AND h.datetime_utc <= b.datetime_utc
  AND h.datetime_utc > b.datetime_utc - INTERVAL '7' DAY GROUP BY b.community_code, b.datetime_utc"""


@query("trailing_day_mean_w1", f"{SLOT}, mean_24h:f9", "W1", _TRAILING)
def _(spark, sf):
    return A.trailing_stats(base(spark, sf), "alpha", {"mean_24h": ("mean", DAY_SECONDS)})


@query("trailing_week_mean_w2", f"{SLOT}, mean_7d:f9", "W2", _TRAILING)
def _(spark, sf):
    return A.trailing_stats(base(spark, sf), "alpha", {"mean_7d": ("mean", 7 * DAY_SECONDS)})


@query("trailing_week_std_w3", f"{SLOT}, mean_24h:f9, mean_7d:f9, std_7d:f9", "W1 W2 W3 F12", _TRAILING)
def _(spark, sf):
    return A.trailing_stats(base(spark, sf), "alpha", {
        "mean_24h": ("mean", DAY_SECONDS), "mean_7d": ("mean", 7 * DAY_SECONDS), "std_7d": ("std", 7 * DAY_SECONDS)})


@query("positional_week_lag_w4", f"{SLOT}, alpha_d7:f9", "W4 T6",
       "SELECT b.community_code, b.datetime_utc, p.alpha AS alpha_d7 FROM (SELECT *, row_number() OVER (PARTITION BY "
       "community_code ORDER BY datetime_utc) AS i FROM base) b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY "
       "community_code ORDER BY datetime_utc) AS i FROM base) p ON p.community_code = b.community_code AND p.i = b.i - 672")
def _(spark, sf):
    return A.positional_lag(base(spark, sf), "alpha", 672, "alpha_d7")


@query("positional_count_lag_w5", f"{SLOT}, n_clients_d2:i", "W5 T6",
       "SELECT b.community_code, b.datetime_utc, p.n_clients AS n_clients_d2 FROM (SELECT *, row_number() OVER (PARTITION BY "
       "community_code ORDER BY datetime_utc) AS i FROM base) b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY "
       "community_code ORDER BY datetime_utc) AS i FROM base) p ON p.community_code = b.community_code AND p.i = b.i - 192")
def _(spark, sf):
    return A.positional_lag(base(spark, sf), "n_clients", 192, "n_clients_d2")


_HOLIDAY = "community_code:s, target_date:d, is_holiday:i"


def _holiday_days(spark, sf):
    return holidays.holiday_days(holidays.daily_holidays(base_daily(spark, sf)))


@query("holiday_lag_lead_w6_o18", f"{_HOLIDAY}, hol_prev:i, hol_2prev:i, hol_next:i, hol_2next:i, hol_7d_ago:i, is_bridge:i",
       "W6 O18 A24", "SELECT * FROM holiday_daily_d")
def _(spark, sf):
    return _holiday_days(spark, sf)


@query("days_since_holiday_w7_o19", f"{_HOLIDAY}, days_since_hol:i", "W7 O19", "SELECT * FROM holiday_daily_d")
def _(spark, sf):
    return _holiday_days(spark, sf)


@query("days_to_holiday_w8_o19", f"{_HOLIDAY}, days_to_hol:i", "W8 O19", "SELECT * FROM holiday_daily_d")
def _(spark, sf):
    return _holiday_days(spark, sf)


@query("rolling_month_same_weekday_w9", f"{SLOT}, mean_28d:f9, std_28d:f9, same_dow:f9", "W9",
       "SELECT b.community_code, b.datetime_utc, avg(h.alpha) AS mean_28d, stddev_samp(h.alpha) AS std_28d, "
       "avg(h.alpha) FILTER (h.datetime_utc IN (b.datetime_utc - INTERVAL '7' DAY, b.datetime_utc - INTERVAL '14' DAY, "
       "b.datetime_utc - INTERVAL '21' DAY, b.datetime_utc - INTERVAL '28' DAY)) AS same_dow FROM base_d b "
       "LEFT JOIN base_d h ON h.community_code = b.community_code AND h.datetime_utc <= b.datetime_utc "
       "AND h.datetime_utc >= b.datetime_utc - INTERVAL '28' DAY GROUP BY 1, 2")
def _(spark, sf):
    # 28 days and one second, so that the row exactly 28 days back belongs to the frame.
    span = 28 * DAY_SECONDS + 1
    rows = A.trailing_stats(base_daily(spark, sf), "alpha", {"mean_28d": ("mean", span), "std_28d": ("std", span)})
    return A.same_dow_mean(rows, "alpha", "same_dow", 28)


@query("first_date_window_w10", "community_code:s, datetime_utc:t, first_date:d", "W10",
       "SELECT community_code, datetime_utc, min(target_date) OVER (PARTITION BY community_code) AS first_date FROM base_d")
def _(spark, sf):
    rows = base_daily(spark, sf)
    return rows.join(first_date(rows), "community_code")


@query("top_per_group_w11", "community_code:s, client_id:s, total_kw:f2, rank:i", "W11",
       "SELECT * FROM (SELECT community_code, client_id, round(sum(active_kw), 2) AS total_kw, row_number() OVER (PARTITION BY "
       "community_code ORDER BY round(sum(active_kw), 2) DESC NULLS LAST, client_id) AS rank FROM readings GROUP BY 1, 2) WHERE rank <= 5")
def _(spark, sf):
    energy = client_energy(Meter(spark, sf).readings, ("community_code", "client_id")).withColumn(
        "total_kw", F.round("total_kw", 2))
    return diagnostics.top_per_group(
        energy, ["community_code"], [F.desc_nulls_last("total_kw"), F.asc("client_id")], 5)


@query("top_clients_t1", "client_id:s, total_kw:f2", "T1",
       "SELECT client_id, sum(active_kw) AS total_kw FROM readings GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 30")
def _(spark, sf):
    return top_clients(Meter(spark, sf).readings, 30)


@query("ordered_preview_t2", f"{SLOT}, n_clients:i, total_kw:f2", "T2",
       "SELECT * FROM panel ORDER BY datetime_utc, community_code LIMIT 20")
def _(spark, sf):
    return panel(spark, sf).orderBy("datetime_utc", "community_code").limit(20)


@query("worst_days_t3", "date:d, err_model:f4, err_base:f4, lift_pct:f4", "T3",
       "SELECT *, CASE WHEN err_base > 0 THEN (1 - err_model / err_base) * 100 END AS lift_pct FROM (SELECT CAST(datetime_utc AS "
       "DATE) AS date, abs(sum(pred_kw) - sum(total_kw)) AS err_model, abs(sum(baseline_kw) - sum(total_kw)) AS err_base "
       "FROM oof GROUP BY 1) ORDER BY err_model DESC, date LIMIT 15")
def _(spark, sf):
    return diagnostics.worst_days(oof(spark, sf), 15)


_CELLS = """SELECT *, CASE WHEN mae_base > 0 THEN (1 - mae_model / mae_base) * 100 END AS lift_pct FROM (
  SELECT isodow(datetime_utc) - 1 AS dow, hour(datetime_utc) AS hour, avg(abs(baseline_kw - total_kw)) AS mae_base,
    avg(abs(pred_kw - total_kw)) AS mae_model, count(*) AS n FROM oof GROUP BY 1, 2)"""


@query("worst_cells_t4", "dow:i, hour:i, mae_base:f4, mae_model:f4, lift_pct:f4", "T4",
       f"SELECT * FROM ({_CELLS}) WHERE lift_pct IS NOT NULL ORDER BY lift_pct, dow, hour LIMIT 20")
def _(spark, sf):
    return diagnostics.worst_cells(oof(spark, sf), 20)


@query("sort_by_null_share_t7", "community_code:s, total_null_readings:i, total_reporting:i, null_pct:f6", "T7 Q9",
       "SELECT community_code, sum(n_missing) AS total_null_readings, sum(n_reporting) AS total_reporting, 100.0e0 * "
       "sum(n_missing) / (sum(n_missing) + sum(n_reporting)) AS null_pct FROM panel GROUP BY 1 ORDER BY null_pct DESC")
def _(spark, sf):
    return null_rate(panel(spark, sf))


@query("stacked_folds_u1", "fold:i, n_rows:i, total_kw:f2", "U1",
       "SELECT fold, count(*) AS n_rows, sum(total_kw) AS total_kw FROM oof GROUP BY fold")
def _(spark, sf):
    return oof(spark, sf).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_kw").alias("total_kw"))


@query("distinct_slots_u2", "datetime_utc:t", "U2", "SELECT DISTINCT datetime_utc FROM readings")
def _(spark, sf):
    return Meter(spark, sf).readings.select("datetime_utc").distinct()


@query("train_or_valid_u3", f"{SLOT}, target_date:d", "U3",
       "SELECT * FROM base WHERE target_date < DATE '2024-01-12' OR (target_date >= DATE '2024-01-14' "
       "AND target_date < DATE '2024-01-19')")
def _(spark, sf):
    train_end, start, end = (F.lit(d).cast("date") for d in FOLDS[0])
    d = F.col("target_date")
    return base(spark, sf).filter((d < train_end) | ((d >= start) & (d < end)))


@query("date_functions_f1", "o_orderkey:i, day:d, week_later:d, month_name:s, days_in:i, hour_start:t", "F1",
       "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 7 AS week_later, "
       "strftime(o_orderdate, '%Y-%m') AS month_name, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS days_in, "
       "date_trunc('hour', o_orderdate) AS hour_start FROM orders")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    ts = F.col("o_orderdate").cast("timestamp_ntz")
    return orders.select(
        "o_orderkey", F.to_date(ts).alias("day"), F.date_add(F.to_date(ts), 7).alias("week_later"),
        F.date_format(ts, "yyyy-MM").alias("month_name"),
        F.datediff(F.to_date(ts), F.lit("1995-01-01").cast("date")).alias("days_in"), hour_start(ts).alias("hour_start"))


@query("clock_parts_f2", "event_id:i, hour:i, minute:i, dow_sunday:i, dow_monday:i, dom:i, doy:i", "F2",
       "SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, dayofweek(ts) + 1 AS dow_sunday, isodow(ts) - 1 AS dow_monday, "
       "day(ts) AS dom, dayofyear(ts) AS doy FROM events")
def _(spark, sf):
    ts = F.col("ts")
    return Meter(spark, sf).events.select(
        "event_id", F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.dayofweek(ts).alias("dow_sunday"),
        F.weekday(ts).alias("dow_monday"), F.dayofmonth(ts).alias("dom"), F.dayofyear(ts).alias("doy"))


@query("interval_arithmetic_f3", "event_id:i, later:t, seconds:i, slot_second:i, parsed:t", "F3",
       "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '7' DAY AS later, CAST(floor(epoch(ts)) AS BIGINT) AS "
       "seconds, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS slot_second, CAST(strftime(ts, '%Y-%m-%d') || ' 06:00:00' AS TIMESTAMP) "
       "AS parsed FROM events")
def _(spark, sf):
    return Meter(spark, sf).events.select(
        "event_id", days_later(slot_start("ts"), 7).alias("later"), epoch_seconds("ts").alias("seconds"),
        second_of_day("ts").alias("slot_second"),
        F.to_timestamp_ntz(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 06:00:00"))).alias("parsed"))


@query("slot_grid_f4", "community_code:s, n_slots:i, first_slot:t, last_slot:t", "F4",
       f"SELECT community_code, count(*) AS n_slots, min(datetime_utc) AS first_slot, max(datetime_utc) AS last_slot FROM ({_GRID}) GROUP BY 1")
def _(spark, sf):
    return quality.slot_grid(panel(spark, sf)).groupBy("community_code").agg(
        F.count(F.lit(1)).alias("n_slots"), F.min("datetime_utc").alias("first_slot"), F.max("datetime_utc").alias("last_slot"))


@query("trigonometry_f5", "o_orderkey:i, sin_doy:f6, cos_doy:f6, tan_decl:f6, acos_decl:f6", "F5",
       "SELECT o_orderkey, sin(2 * pi() * dayofyear(o_orderdate) / 366) AS sin_doy, cos(2 * pi() * dayofyear(o_orderdate) / 366) "
       "AS cos_doy, tan(radians(dayofyear(o_orderdate) / 10.0)) AS tan_decl, acos(sin(dayofyear(o_orderdate))) AS acos_decl FROM orders")
def _(spark, sf):
    doy = F.dayofyear("o_orderdate")
    angle = F.lit(2.0) * F.pi() * doy / 366
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.sin(angle).alias("sin_doy"), F.cos(angle).alias("cos_doy"),
        F.tan(F.radians(doy / 10.0)).alias("tan_decl"), F.acos(F.sin(doy)).alias("acos_decl"))


@query("logarithms_f6", f"{SLOT}, log_kw:f6, back:f4", "F6",
       f"SELECT community_code, datetime_utc, ln({floor_at('total_kw', '1.0')}) AS log_kw, {floor_at('total_kw', '1.0')} AS back FROM panel")
def _(spark, sf):
    return panel(spark, sf).withColumn("log_kw", safe_log("total_kw")).withColumn("back", F.exp("log_kw"))


@query("arithmetic_f7", f"{SLOT}, off_mean:f4, lesser:f2, greater:f2, tens:i", "F7",
       "SELECT community_code, datetime_utc, abs(min_kw - mean_kw) AS off_mean, least(min_kw, 20.0) AS lesser, "
       "greatest(max_kw, 20.0) AS greater, CAST(floor(total_kw) AS BIGINT) // 10 AS tens FROM panel WHERE total_kw IS NOT NULL")
def _(spark, sf):
    rows = panel(spark, sf).filter(F.col("total_kw").isNotNull())
    return rows.select(
        "community_code", "datetime_utc", F.abs(F.col("min_kw") - F.col("mean_kw")).alias("off_mean"),
        F.least("min_kw", F.lit(20.0)).alias("lesser"), F.greatest("max_kw", F.lit(20.0)).alias("greater"),
        F.expr("CAST(floor(total_kw) AS BIGINT) div 10").alias("tens"))


@query("row_median_f9_o16", f"{SLOT}, alpha_lag_median4:f9", "F9 O16",
       "SELECT community_code, datetime_utc, (SELECT median(v) FROM (VALUES (alpha_lag_7d), (alpha_lag_14d), (alpha_lag_21d), "
       "(alpha_lag_28d)) t(v)) AS alpha_lag_median4 FROM lagged")
def _(spark, sf):
    lags = [f"alpha_lag_{n}d" for n in (7, 14, 21, 28)]
    return A.robust_lag(A.with_alpha_lags(base(spark, sf)), lags)


@query("row_mean_f10_o4", _LAG_COLUMNS + ", alpha_lag_mean:f9", "F10 O4", "SELECT * FROM lagged")
def _(spark, sf):
    return A.with_alpha_lags(base(spark, sf))


@query("constants_f11", "community_code:s, unit:s, stamped:i, n_rows:i", "F11",
       "SELECT community_code, 'kW' AS unit, 1 AS stamped, count(*) AS n_rows FROM readings GROUP BY 1")
def _(spark, sf):
    return Meter(spark, sf).readings.groupBy("community_code").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "community_code", F.lit("kW").alias("unit"), F.current_timestamp().isNotNull().cast("int").alias("stamped"), "n_rows")


@query("percentile_stddev_f12", "community_code:s, median_kw:f2, std_kw:f6", "F12",
       "SELECT community_code, quantile_disc(active_kw, 0.5) AS median_kw, stddev_samp(active_kw) AS std_kw FROM readings_d GROUP BY 1")
def _(spark, sf):
    rows = staged(Daily(spark, sf).readings.select("community_code", "active_kw"), "readings-d")
    middle = exact_quantiles(rows, ["community_code"], "active_kw", [0.5]).select("community_code", F.col("value").alias("median_kw"))
    return rows.groupBy("community_code").agg(F.stddev_samp("active_kw").alias("std_kw")).join(middle, "community_code")
