"""SQL tables that the comparison queries build on, written independently of the Spark code.

Lags are self joins here, trailing statistics are correlated ranges, holiday distances are computed from
dates, so agreement says something.
"""

from __future__ import annotations

import re

FOLDS = [
    ("2024-01-12", "2024-01-14", "2024-01-19"),
    ("2024-01-17", "2024-01-19", "2024-01-24"),
    ("2024-01-22", "2024-01-24", "2024-01-31"),
]
METER_MIN_ROWS = 40

_FOLD_ROWS = ", ".join(f"({i}, DATE '{a}', DATE '{b}', DATE '{c}')" for i, (a, b, c) in enumerate(FOLDS))


def _lag(n: int) -> str:
    return (f"LEFT JOIN base l{n} ON l{n}.community_code = b.community_code "
            f"AND l{n}.datetime_utc = b.datetime_utc - INTERVAL '{n}' DAY")


def _circle(name: str, phase: str, period: str) -> str:
    return f"sin(2 * pi() * {phase} / {period}) AS sin_{name}, cos(2 * pi() * {phase} / {period}) AS cos_{name}"


CLOCK = f"""hour(datetime_local) AS hour, minute(datetime_local) // 15 AS qhour,
  hour(datetime_local) * 4 + minute(datetime_local) // 15 AS mod, dayofweek(datetime_local) + 1 AS dow,
  month(datetime_local) AS month, dayofyear(datetime_local) AS doy,
  CASE WHEN dayofweek(datetime_local) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
  {_circle("mod", "(hour(datetime_local) * 4 + minute(datetime_local) // 15)", "96")},
  {_circle("dow", "(dayofweek(datetime_local) + 1)", "7")}"""

CYCLIC = f"""hour(datetime_local) * 4 + minute(datetime_local) // 15 AS qhour,
  isodow(datetime_local) - 1 AS dow, day(datetime_local) AS dom, dayofyear(datetime_local) AS doy,
  month(datetime_local) AS month, CASE WHEN isodow(datetime_local) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  {_circle("qhour", "(hour(datetime_local) * 4 + minute(datetime_local) // 15)", "96")},
  {_circle("dow", "(isodow(datetime_local) - 1)", "7")}, {_circle("doy", "dayofyear(datetime_local)", "366")}"""

# The seasons of holidays, as in the library.
HOL_TYPE = """CASE WHEN is_holiday = 0 THEN 'none'
  WHEN month(target_date) * 100 + day(target_date) BETWEEN 413 AND 421
    OR month(target_date) * 100 + day(target_date) BETWEEN 325 AND 331 THEN 'easter'
  WHEN month(target_date) * 100 + day(target_date) BETWEEN 501 AND 508
    OR month(target_date) * 100 + day(target_date) BETWEEN 428 AND 430 THEN 'puente'
  WHEN month(target_date) * 100 + day(target_date) BETWEEN 810 AND 820 THEN 'assumption'
  WHEN month(target_date) * 100 + day(target_date) >= 1220
    OR month(target_date) * 100 + day(target_date) <= 107 THEN 'xmas_reyes'
  ELSE 'regular' END"""


def share(total: str, clients: str, demand: str) -> str:
    return f"CASE WHEN {clients} > 0 AND {demand} > 0 THEN {total} / ({clients} * {demand}) END"


def floor_at(x: str, low: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, {low}) END"


def holiday_days(source: str) -> str:
    """Daily holiday features by position among the days present, from pairs of days."""
    return f"""SELECT d.community_code, d.target_date, d.is_holiday,
  COALESCE(p1.is_holiday, 0) AS hol_prev, COALESCE(p2.is_holiday, 0) AS hol_2prev,
  COALESCE(n1.is_holiday, 0) AS hol_next, COALESCE(n2.is_holiday, 0) AS hol_2next,
  COALESCE(p7.is_holiday, 0) AS hol_7d_ago,
  CASE WHEN COALESCE(p1.is_holiday, 0) = 1 OR COALESCE(n1.is_holiday, 0) = 1 THEN 1 ELSE 0 END AS is_bridge,
  least(30, COALESCE(d.i - (SELECT max(h.i) FROM {source} h WHERE h.community_code = d.community_code
     AND h.is_holiday = 1 AND h.i <= d.i), 30)) AS days_since_hol,
  least(30, COALESCE((SELECT min(h.i) FROM {source} h WHERE h.community_code = d.community_code
     AND h.is_holiday = 1 AND h.i >= d.i) - d.i, 30)) AS days_to_hol
FROM {source} d
LEFT JOIN {source} p1 ON p1.community_code = d.community_code AND p1.i = d.i - 1
LEFT JOIN {source} p2 ON p2.community_code = d.community_code AND p2.i = d.i - 2
LEFT JOIN {source} p7 ON p7.community_code = d.community_code AND p7.i = d.i - 7
LEFT JOIN {source} n1 ON n1.community_code = d.community_code AND n1.i = d.i + 1
LEFT JOIN {source} n2 ON n2.community_code = d.community_code AND n2.i = d.i + 2"""


def cell_median(source: str, scope: str, slot: str, target: str, min_rows: int, median: str = "median({})") -> str:
    """Rows of ``source`` with role 'valid', plus ``correction`` learned from its 'train' rows."""
    def on(alias: str, *cols: str) -> str:
        return " AND ".join(f"{alias}.{c} = v.{c}" for c in cols)
    keys = [c.strip() for c in scope.split(",")]
    train = f"(SELECT * FROM {source} WHERE role = 'train' AND {target} IS NOT NULL)"
    med = median.format(target)
    return f"""SELECT v.*, CASE WHEN s.n >= {min_rows} THEN COALESCE(f.med, c.med, 0.0) ELSE 0.0 END AS correction
FROM {source} v
LEFT JOIN (SELECT {scope}, {slot}, dow, {med} AS med FROM {train} GROUP BY {scope}, {slot}, dow) f
  ON {on("f", *keys, slot, "dow")}
LEFT JOIN (SELECT {scope}, {slot}, {med} AS med FROM {train} GROUP BY {scope}, {slot}) c ON {on("c", *keys, slot)}
LEFT JOIN (SELECT {scope}, count(*) AS n FROM {train} GROUP BY {scope}) s ON {on("s", *keys)}
WHERE v.role = 'valid'"""


TABLES = {
    "readings": """SELECT CAST(user_id AS VARCHAR) AS client_id, event_type AS community_code,
  time_bucket(INTERVAL '15 minutes', ts) AS datetime_utc,
  time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '1' HOUR AS datetime_local,
  SUM(CASE WHEN value >= 2 THEN value END) AS active_kw
FROM events GROUP BY 1, 2, 3, 4""",
    "raw_readings": """SELECT CAST(user_id AS VARCHAR) AS client_id, event_type AS community_code,
  time_bucket(INTERVAL '15 minutes', ts) AS datetime_utc, time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '1' HOUR AS datetime_local,
  CASE WHEN value >= 2 THEN value END AS active_kw FROM events""",
    "demand": """SELECT h AS datetime_utc, CASE WHEN hour(h) = 3 AND day(h) IN (4, 13, 22) THEN 0.0e0
  ELSE 20000.0e0 + 250 * abs(12 - hour(h)) + 40 * day(h) + 5 * n END AS value
FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1)
WHERE NOT (hour(h) = 4 AND day(h) IN (5, 14, 23))""",
    "generation": """SELECT date_trunc('hour', ts) AS datetime_utc, sum(value) AS value
FROM events GROUP BY 1""",
    "weather": """SELECT community_code, 'P' || community_code AS province, time,
  CASE WHEN NOT (h = 7 AND d = 8) THEN warm END AS temperature_2m, warm - 1.5e0 AS apparent_temperature,
  40.0e0 + 2 * abs(12 - h) AS relative_humidity_2m,
  CASE WHEN d IN (3, 7, 12, 20) THEN 0.2e0 * h ELSE 0.0e0 END AS precipitation,
  3.0e0 * d + h AS cloud_cover, 5.0e0 + 0.5e0 * abs(6 - h) AS wind_speed_10m,
  CASE WHEN h BETWEEN 8 AND 17 THEN 60.0e0 * (10 - abs(13 - h)) ELSE 0.0e0 END AS shortwave_radiation,
  CASE WHEN h BETWEEN 8 AND 17 THEN 30.0e0 * (10 - abs(13 - h)) ELSE 0.0e0 END AS diffuse_radiation,
  CASE WHEN h BETWEEN 8 AND 17 THEN 1 ELSE 0 END AS is_day
FROM (SELECT *, -2.0e0 + 1.25e0 * h - 0.3e0 * abs(15 - d) + 0.25e0 * length(community_code) + k AS warm
  FROM (SELECT community_code, time, hour(time) AS h, day(time) AS d,
      unnest(CASE WHEN day(time) IN (11, 21) THEN [0, 1] ELSE [0] END) AS k
    FROM (SELECT DISTINCT event_type AS community_code,
        time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '1' HOUR AS time FROM events)
    WHERE NOT (hour(time) = 5 AND day(time) IN (9, 19))))""",
    "weather1": """SELECT * EXCLUDE (province, rn) RENAME (time AS datetime_local) FROM (
  SELECT *, row_number() OVER (PARTITION BY community_code, time ORDER BY
    (temperature_2m IS NULL)::INT + (apparent_temperature IS NULL)::INT, temperature_2m NULLS FIRST, apparent_temperature NULLS FIRST) AS rn
  FROM weather)
WHERE rn = 1""",
    "holidays": """SELECT CAST(ts + INTERVAL '1' HOUR AS DATE) AS date FROM events
WHERE day(ts + INTERVAL '1' HOUR) IN (1, 6, 15, 26)""",
    "regional_holidays": """SELECT DISTINCT event_type AS community_code, CAST(ts + INTERVAL '1' HOUR AS DATE) AS date FROM events
WHERE day(ts + INTERVAL '1' HOUR) % (length(event_type) + 3) = 0""",
    "first_seen": "SELECT client_id, min(datetime_utc) AS first_utc FROM readings GROUP BY client_id",
    "panel": """SELECT community_code, datetime_utc, min(datetime_local) AS datetime_local,
  count(DISTINCT client_id) AS n_clients, sum(CASE WHEN active_kw IS NULL THEN 1 ELSE 0 END) AS n_missing,
  sum(CASE WHEN datetime_utc = first_utc THEN 1 ELSE 0 END) AS n_new_clients, sum(active_kw) AS total_kw,
  avg(active_kw) AS mean_kw, quantile_disc(active_kw, 0.5) AS median_kw, stddev_samp(active_kw) AS std_kw,
  min(active_kw) AS min_kw, max(active_kw) AS max_kw, count(active_kw) AS n_reporting,
  sum(active_kw) / count(DISTINCT client_id) AS avg_kw_per_client,
  CASE WHEN count(active_kw) > 0 THEN sum(active_kw) / count(active_kw) END AS avg_kw_reporting
FROM readings JOIN first_seen USING (client_id) GROUP BY community_code, datetime_utc""",
    "base": f"""SELECT p.*, d.value AS D_mw, {share("p.total_kw", "p.n_clients", "d.value")} AS alpha,
  CAST(p.datetime_local AS DATE) AS target_date
FROM panel p LEFT JOIN demand d ON d.datetime_utc = date_trunc('hour', p.datetime_utc)""",
    "lagged": f"""SELECT b.*, l2.alpha AS alpha_lag_2d, l7.alpha AS alpha_lag_7d, l14.alpha AS alpha_lag_14d,
  l21.alpha AS alpha_lag_21d, l28.alpha AS alpha_lag_28d,
  (SELECT avg(v) FROM (VALUES (l2.alpha), (l7.alpha), (l14.alpha), (l21.alpha), (l28.alpha)) t(v)) AS alpha_lag_mean
FROM base b {_lag(2)} {_lag(7)} {_lag(14)} {_lag(21)} {_lag(28)}""",
    "snapshot": """SELECT c.community_code, CAST(c.datetime_local AS DATE) + 1 AS target_date,
  any_value(c.alpha) AS sn_alpha_last,
  avg(h.alpha) FILTER (h.datetime_utc > c.datetime_utc - INTERVAL '24' HOUR) AS sn_alpha_mean_24h,
  avg(h.alpha) AS sn_alpha_mean_7d, stddev_samp(h.alpha) AS sn_alpha_std_7d,
  any_value(c.n_clients) AS n_clients_at_cutoff
FROM base c LEFT JOIN base h ON h.community_code = c.community_code AND h.datetime_utc <= c.datetime_utc
  AND h.datetime_utc > c.datetime_utc - INTERVAL '7' DAY
WHERE hour(c.datetime_local) = 11 AND minute(c.datetime_local) = 45
GROUP BY c.community_code, c.datetime_local""",
    "first_dates": "SELECT community_code, min(CAST(datetime_local AS DATE)) AS first_date FROM readings GROUP BY 1",
    "features": f"""SELECT l.community_code, l.target_date, l.datetime_utc, l.datetime_local, l.total_kw, l.n_clients,
  l.alpha AS y, l.alpha_lag_2d, l.alpha_lag_7d, l.alpha_lag_14d, l.alpha_lag_21d, l.alpha_lag_28d, l.alpha_lag_mean,
  s.sn_alpha_last, s.sn_alpha_mean_24h, s.sn_alpha_mean_7d, s.sn_alpha_std_7d, s.n_clients_at_cutoff, l.D_mw,
  {CLOCK.replace("datetime_local", "l.datetime_local")},
  CASE WHEN l.target_date IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
  w.temperature_2m, w.apparent_temperature, w.relative_humidity_2m, w.precipitation, w.cloud_cover,
  w.wind_speed_10m, w.shortwave_radiation, w.diffuse_radiation, w.is_day,
  l.target_date - f.first_date AS age_days
FROM lagged l LEFT JOIN snapshot s USING (community_code, target_date)
LEFT JOIN weather1 w ON w.community_code = l.community_code AND w.datetime_local = l.datetime_local
JOIN first_dates f ON f.community_code = l.community_code
WHERE l.alpha IS NOT NULL""",
    # Training tables at one week and at four weeks of required history.
    "x": "SELECT * FROM features WHERE age_days >= 7",
    "x28": "SELECT * FROM features WHERE age_days >= 28",
    "train_rows": f"""SELECT *, ln({floor_at("total_kw", "1.0")}) - ln(baseline_kw) AS y_log FROM (
  SELECT *, {floor_at("alpha_lag_7d * n_clients_at_cutoff * D_mw", "1.0")} AS baseline_kw,
    {floor_at("total_kw", "1.0")} AS total_pos
  FROM x WHERE alpha_lag_7d IS NOT NULL)""",
    "folds": f"SELECT * FROM (VALUES {_FOLD_ROWS}) f(fold, train_end, valid_start, valid_end)",
    "placed": """SELECT t.*, f.fold, CASE WHEN t.target_date < f.train_end THEN 'train' ELSE 'valid' END AS role
FROM train_rows t JOIN folds f ON t.target_date < f.train_end
  OR (t.target_date >= f.valid_start AND t.target_date < f.valid_end)
WHERE t.baseline_kw IS NOT NULL""",
    "oof": f"""SELECT *, baseline_kw * exp(greatest(-0.5, least(0.5, correction))) AS pred_kw
FROM ({cell_median("placed", "fold, community_code", "mod", "y_log", METER_MIN_ROWS)})""",
    "oof_pooled": f"""SELECT *, baseline_kw * exp(greatest(-0.5, least(0.5, correction))) AS pred_kw
FROM ({cell_median("placed", "fold", "mod", "y_log", METER_MIN_ROWS, "quantile_disc({}, 0.5)")})""",
    "oof_slots": """SELECT fold, datetime_utc, sum(total_kw) AS actual, sum(baseline_kw) AS baseline, sum(pred_kw) AS pred
FROM oof GROUP BY fold, datetime_utc""",
    "holiday_numbered": """SELECT community_code, target_date, max(is_holiday) AS is_holiday,
  row_number() OVER (PARTITION BY community_code ORDER BY target_date) AS i FROM x GROUP BY community_code, target_date""",
    "holiday_daily": holiday_days("holiday_numbered"),
    # Days that have a weekly lag, as the training rows do.
    "holiday_numbered_lagged": """SELECT community_code, target_date, max(is_holiday) AS is_holiday,
  row_number() OVER (PARTITION BY community_code ORDER BY target_date) AS i FROM train_rows GROUP BY 1, 2""",
    "holiday_daily_lagged": holiday_days("holiday_numbered_lagged"),
    # Daily portfolio.
    "readings_d": """SELECT CAST(o_custkey AS VARCHAR) AS client_id, c_mktsegment AS community_code,
  o_orderdate AS datetime_utc, o_orderdate AS datetime_local,
  sum(CASE WHEN o_totalprice >= 2000 THEN o_totalprice END) AS active_kw
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3""",
    "demand_d": """SELECT o_orderdate AS datetime_utc, 20000.0e0 + 10 * count(*) + dayofyear(o_orderdate) AS value
FROM orders GROUP BY o_orderdate""",
    "holidays_d": """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
WHERE month(o_orderdate) * 100 + day(o_orderdate) IN (101, 106, 328, 417, 429, 501, 815, 1012, 1101, 1206, 1208, 1225)""",
    "base_d": f"""SELECT p.*, d.value AS D_mw, {share("p.total_kw", "p.n_clients", "d.value")} AS alpha,
  CAST(p.datetime_local AS DATE) AS target_date,
  CASE WHEN CAST(p.datetime_local AS DATE) IN (SELECT date FROM holidays_d) THEN 1 ELSE 0 END AS is_holiday
FROM (SELECT community_code, datetime_utc, min(datetime_local) AS datetime_local, sum(active_kw) AS total_kw,
    count(DISTINCT client_id) AS n_clients FROM readings_d GROUP BY 1, 2) p
LEFT JOIN demand_d d USING (datetime_utc)""",
    "holiday_numbered_d": """SELECT community_code, target_date, max(is_holiday) AS is_holiday,
  row_number() OVER (PARTITION BY community_code ORDER BY target_date) AS i
FROM base_d GROUP BY community_code, target_date""",
    "holiday_daily_d": holiday_days("holiday_numbered_d"),
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def with_tables(body: str) -> str:
    """Prefix ``body`` with the tables it names, inner ones first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for word in dict.fromkeys(_WORD.findall(TABLES[name])):
            if word in TABLES and word != name:
                visit(word)
        ordered.append(name)

    for word in dict.fromkeys(_WORD.findall(body)):
        if word in TABLES:
            visit(word)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in ordered) + "\n" + body
