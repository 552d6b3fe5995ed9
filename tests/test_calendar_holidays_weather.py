import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from support import at, by_key, days
from wattshare.functions.rowwise import clip, ratio, row_mean, safe_log
from wattshare.operators import calendar as C
from wattshare.operators import holidays as H
from wattshare.operators import quality as Q
from wattshare.operators import weather as W


def test_clock_calendar(spark):
    df = spark.createDataFrame([(at("2025-03-02 18:45"),)], "datetime_local timestamp_ntz")
    r = C.with_calendar(df).collect()[0]
    assert (r.hour, r.qhour, r.mod, r.dow, r.month, r.doy, r.is_weekend) == (18, 3, 75, 1, 3, 61, 1)
    assert r.sin_mod == pytest.approx(math.sin(2 * math.pi * 75 / 96)) and r.cos_dow == pytest.approx(math.cos(2 * math.pi / 7))
    assert all(x.violations == 0 for x in Q.check_calendar(C.with_calendar(df)).collect())
    assert by_key(Q.check_calendar(C.with_calendar(df).withColumn("dow", F.lit(2))), "rule")["dow"].violations == 1


def test_cyclic_calendar_and_bad_style(spark):
    df = spark.createDataFrame([(at("2024-12-31 00:15"),)], "datetime_local timestamp_ntz")
    r = C.with_calendar(df, "cyclic").collect()[0]
    assert (r.qhour, r.dow, r.dom, r.doy, r.is_weekend) == (1, 1, 31, 366, 0)
    assert r.sin_doy == pytest.approx(0, abs=1e-12) and r.cos_doy == pytest.approx(1)
    with pytest.raises(ValueError):
        C.with_calendar(df, "lunar")


def test_daylight_is_longest_in_june_and_bounded(spark):
    df = C.with_daylight(spark.range(1, 366).select(F.col("id").alias("doy")))
    rows = {r.doy: r.daylight_h for r in df.collect()}
    assert max(rows, key=rows.get) in range(170, 175) and rows[172] == pytest.approx(14.85, abs=0.1)
    assert rows[81] == pytest.approx(12.0, abs=0.01)
    polar = C.with_daylight(spark.range(1, 366).select(F.col("id").alias("doy")), 80.0)
    assert polar.agg(F.min("daylight_h"), F.max("daylight_h")).collect()[0][:] == (0.0, 24.0)


def _typed(spark, *dates):
    df = spark.createDataFrame([(date.fromisoformat(d), 1) for d in dates], "target_date date, is_holiday int")
    return {str(r.target_date)[5:]: r.hol_type for r in H.with_holiday_type(df).collect()}


def test_holiday_seasons(spark):
    assert _typed(spark, "2025-04-13", "2025-04-21", "2025-03-25", "2025-05-01", "2025-05-08", "2025-04-28", "2025-08-10",
                  "2025-08-20", "2025-12-20", "2025-01-01", "2025-01-07") == {
        "04-13": "easter", "04-21": "easter", "03-25": "easter", "05-01": "puente", "05-08": "puente", "04-28": "puente",
        "08-10": "assumption", "08-20": "assumption", "12-20": "xmas_reyes", "01-01": "xmas_reyes", "01-07": "xmas_reyes"}
    assert set(_typed(spark, "2025-04-12", "2025-04-22", "2025-03-24", "2025-05-09", "2025-04-27", "2025-08-21", "2025-12-19",
                      "2025-01-08").values()) == {"regular"}


def test_ordinary_day_has_no_type(spark):
    df = spark.createDataFrame([(date(2025, 12, 25), 0), (date(2025, 12, 25), None)], "target_date date, is_holiday int")
    assert {r.hol_type for r in H.with_holiday_type(df).collect()} == {"none"}


@pytest.fixture
def daily(spark):
    """Sixty days with holidays on days 5 and 50 for N; none for S."""
    rows = [("N", d, int(i in (5, 50))) for i, d in enumerate(days("2025-01-01", 60))]
    rows += [("S", d, 0) for d in days("2025-01-01", 10)]
    return spark.createDataFrame(rows, "community_code string, target_date date, is_holiday int")


def test_distance_is_capped_and_thirty_without_a_holiday(daily):
    rows = by_key(H.holiday_days(daily), "community_code", "target_date")
    first = days("2025-01-01", 60)
    n = [rows["N", d] for d in first]
    assert [n[i].days_since_hol for i in (0, 5, 6, 34, 35, 49, 50, 59)] == [30, 0, 1, 29, 30, 30, 0, 9]
    assert [n[i].days_to_hol for i in (0, 5, 6, 20, 21, 50, 51)] == [5, 0, 30, 30, 29, 0, 30]
    assert {(rows["S", d].days_since_hol, rows["S", d].days_to_hol) for d in first[:10]} == {(30, 30)}


def test_neighbours_bridge_and_mismatch(daily):
    rows = by_key(H.with_holiday_context(daily), "community_code", "target_date")
    n = [rows["N", d] for d in days("2025-01-01", 60)]
    assert [i for i, r in enumerate(n) if r.is_bridge] == [4, 6, 49, 51]
    assert [i for i, r in enumerate(n) if r.hol_2prev] == [7, 52] and [i for i, r in enumerate(n) if r.hol_2next] == [3, 48]
    assert [i for i, r in enumerate(n) if r.hol_mismatch_7d] == [5, 12, 50, 57]
    assert by_key(H.holiday_mismatch(daily), "community_code", "target_date")["N", date(2025, 1, 13)].hol_mismatch_7d == 1


def test_holiday_flag_never_repeats_rows(spark, daily):
    listed = spark.createDataFrame([(date(2025, 1, 6),)] * 3, "date date")
    out = H.with_holiday_flag(daily.drop("is_holiday"), listed)
    assert out.count() == daily.count() and out.agg(F.sum("is_holiday")).collect()[0][0] == 2
    assert H.with_holiday_flag(daily.drop("is_holiday"), None).agg(F.sum("is_holiday")).collect()[0][0] == 0


def test_regional_holidays_stay_regional(spark, daily):
    listed = spark.createDataFrame([("N", date(2025, 1, 6))], "community_code string, date date")
    out = H.with_holiday_flag(daily.drop("is_holiday"), listed, regional=True).filter("is_holiday = 1")
    assert [(r.community_code, r.target_date) for r in out.collect()] == [("N", date(2025, 1, 6))]


def test_degree_days_keep_unknown_temperature_unknown(spark):
    df = spark.createDataFrame([(10.0, 20, 1), (25.0, 10, 0), (None, 20, 1)], "temperature_2m double, hour int, is_weekend int")
    out = W.with_temp_interactions(W.with_degree_days(df)).collect()
    assert [(r.hdd15, r.hdd18, r.cdd22, r.hdd_x_evening) for r in out] == [(5, 8, 0, 8), (0, 0, 3, 0), (None,) * 4]
    assert out[0].temp_x_hour == 200 and out[0].temp_x_weekend == 10


def test_weather_is_optional_and_partial(spark):
    panel = spark.createDataFrame([("N", datetime(2025, 1, 1))], "community_code string, datetime_local timestamp_ntz")
    assert W.attach_weather(panel, None).columns == panel.columns
    weather = spark.createDataFrame([("N", "p", datetime(2025, 1, 1), 3.0)] * 2,
                                    "community_code string, province string, time timestamp_ntz, temperature_2m double")
    out = W.attach_weather(panel, weather)
    assert out.columns == [*panel.columns, "temperature_2m"] and out.count() == 1


def test_row_helpers(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(row_mean(["a", "b"])).collect()] == [1.0, None, 3.0]
    assert [r[0] for r in df.select(clip("a", 1.5, 1.8)).collect()] == [1.5, None, 1.8]
    assert [r[0] for r in df.select(ratio("a", F.lit(0.0))).collect()] == [None] * 3
    assert [r[0] for r in df.select(safe_log("b")).collect()] == [None, None, pytest.approx(math.log(4))]
