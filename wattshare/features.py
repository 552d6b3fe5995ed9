"""Feature catalogue: the column contract of the training tables (fixed values)."""

from wattshare.schemas import WEATHER_MEASURES

LAG_DAYS = (2, 7, 14, 21, 28)
LAGS = [f"alpha_lag_{n}d" for n in LAG_DAYS]
SNAPSHOT = ["sn_alpha_last", "sn_alpha_mean_24h", "sn_alpha_mean_7d", "sn_alpha_std_7d", "n_clients_at_cutoff"]
CALENDAR = ["hour", "qhour", "mod", "dow", "month", "doy", "is_weekend", "sin_mod", "cos_mod", "sin_dow", "cos_dow"]

ROLLING = ["roll_mean_28d", "roll_std_28d", "same_dow_mean_28d"]

BOOKKEEPING = ["community_code", "target_date", "datetime_utc", "datetime_local", "total_kw", "n_clients"]
BASE_FEATURES = LAGS + ["alpha_lag_mean"] + SNAPSHOT + ["D_mw"] + CALENDAR + ["is_holiday"]
FEATURES = BASE_FEATURES + WEATHER_MEASURES
CATEGORICAL = ["community_code", "hour", "qhour", "dow", "month", "is_weekend", "is_day", "is_holiday"]

# Share-only variant: two lags, the client count, calendar and holiday flag.
SHORT_FEATURES = ["alpha_lag_2d", "alpha_lag_7d", "n_clients_at_cutoff", "D_mw"] + CALENDAR + ["is_holiday"]

# Full set for one model per entity; add the entity for a pooled model.
RICH_FEATURES = (
    LAGS + ["alpha_lag_mean"] + SNAPSHOT + ["D_mw", "log_clients", "log_dmw", "baseline_log"] + CALENDAR
    + [f"{fn}_doy_{k}" for k in (1, 2, 3, 4) for fn in ("sin", "cos")]
    + ["hour_of_week", "qhour_of_week", "daylight_h"]
    + ["is_holiday", "hol_prev", "hol_next", "hol_2prev", "hol_2next", "is_bridge"]
    + WEATHER_MEASURES
    + ["hdd15", "hdd18", "cdd22", "temp_x_hour", "temp_x_weekend", "hdd_x_evening"]
)
RICH_CATEGORICAL = ["hour", "qhour", "dow", "month", "is_weekend", "is_day", "is_holiday", "hour_of_week", "qhour_of_week", "is_bridge"]

# Small set for one pooled model.
COMPACT_FEATURES = [
    "alpha_lag_median4", "sn_alpha_last", "sn_alpha_mean_7d", "baseline_log", "qhour_of_week", "sin_doy_1",
    "cos_doy_1", "hol_type", "hol_mismatch_7d", "is_bridge", "days_to_hol", "days_since_hol", "hdd18", "cdd22",
    "community_code",
]
COMPACT_CATEGORICAL = ["qhour_of_week", "hol_type", "hol_mismatch_7d", "is_bridge", "community_code"]
