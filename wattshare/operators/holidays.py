"""Holiday flag, typology and distance.

Neighbour features live on a daily table, one row per (community, day present), and are
joined back once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshare.functions.rowwise import flag
from wattshare.sources.tables import distinct_dates

DAY = ["community_code", "target_date"]


def with_holiday_flag(
    df: DataFrame, holidays: DataFrame | None, date: str = "target_date", regional: bool = False,
) -> DataFrame:
    """``is_holiday`` = 1 when the local date is listed.  Without a list every day is ordinary.

    Every listed date counts everywhere, unless ``regional`` asks that ``community_code`` match too.
    """
    if holidays is None:
        return df.withColumn("is_holiday", F.lit(0))
    listed = holidays.select("community_code", "date").distinct() if regional else distinct_dates(holidays)
    listed = listed.withColumnRenamed("date", "_date")
    match = F.col(date) == F.col("_date")
    if regional:
        listed = listed.withColumnRenamed("community_code", "_region")
        match = match & (F.col("community_code") == F.col("_region"))
    return df.join(listed, match, "left").select(*df.columns, flag(F.col("_date").isNotNull()).alias("is_holiday"))


def with_holiday_type(df: DataFrame, date: str = "target_date") -> DataFrame:
    """Name the season of a holiday by month and day; the first match wins."""
    m, d = F.month(date), F.dayofmonth(date)
    # Fixed values: (label, condition) in order of precedence.
    seasons = [
        ("easter", ((m == 4) & d.between(13, 21)) | ((m == 3) & (d >= 25))),
        ("puente", ((m == 5) & (d <= 8)) | ((m == 4) & (d >= 28))),
        ("assumption", (m == 8) & d.between(10, 20)),
        ("xmas_reyes", ((m == 12) & (d >= 20)) | ((m == 1) & (d <= 7))),
    ]
    label = F.when(~F.coalesce(F.col("is_holiday") == 1, F.lit(False)), F.lit("none"))
    for name, condition in seasons:
        label = label.when(condition, F.lit(name))
    return df.withColumn("hol_type", label.otherwise(F.lit("regular")))


def daily_holidays(df: DataFrame) -> DataFrame:
    return df.groupBy(*DAY).agg(F.max("is_holiday").alias("is_holiday"))


def holiday_days(daily: DataFrame, cap: int = 30, mismatch_days: int = 7) -> DataFrame:
    """All daily holiday features at once: neighbours, bridge, distance and the flag a week ago.

    Offsets count the days present, as a gap-free daily table makes natural.
    """
    w = Window.partitionBy("community_code").orderBy("target_date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    # Running backwards keeps the frame growing row by row; a frame shrinking forwards is rescanned at each row.
    ahead = Window.partitionBy("community_code").orderBy(F.desc("target_date")).rowsBetween(Window.unboundedPreceding, 0)
    holiday_at = F.when(F.col("is_holiday") == 1, F.col("_i"))

    def near(offset: int):
        return F.lag("is_holiday", offset, 0).over(w) if offset > 0 else F.lead("is_holiday", -offset, 0).over(w)

    def capped(distance):
        return F.least(F.coalesce(distance, F.lit(cap)), F.lit(cap))

    numbered = daily.withColumns({
        "_i": F.row_number().over(w), "hol_prev": near(1), "hol_2prev": near(2),
        "hol_next": near(-1), "hol_2next": near(-2), f"hol_{mismatch_days}d_ago": near(mismatch_days)})
    measured = numbered.withColumns({
        "days_since_hol": capped(F.col("_i") - F.max(holiday_at).over(past)),
        "days_to_hol": capped(F.min(holiday_at).over(ahead) - F.col("_i")),
        "is_bridge": flag((F.col("hol_prev") == 1) | (F.col("hol_next") == 1)),
    })
    return measured.drop("_i")


def holiday_neighbours(df: DataFrame) -> DataFrame:
    cols = ["hol_prev", "hol_next", "hol_2prev", "hol_2next", "is_bridge"]
    return df.join(holiday_days(daily_holidays(df)).select(*DAY, *cols), DAY, "left")


def holiday_proximity(df: DataFrame, cap: int = 30) -> DataFrame:
    cols = ["days_since_hol", "days_to_hol"]
    return df.join(holiday_days(daily_holidays(df), cap).select(*DAY, *cols), DAY, "left")


def holiday_mismatch(df: DataFrame, days: int = 7) -> DataFrame:
    """1 where today and the lag day differ in being a holiday."""
    ago, out = f"hol_{days}d_ago", f"hol_mismatch_{days}d"
    daily = holiday_days(daily_holidays(df), mismatch_days=days).select(*DAY, ago)
    return df.join(daily, DAY, "left").withColumn(out, flag(F.col("is_holiday") != F.col(ago)))


def with_holiday_context(df: DataFrame, cap: int = 30, mismatch_days: int = 7) -> DataFrame:
    """Typology, neighbours, distance and mismatch with one daily table and one join."""
    daily = holiday_days(daily_holidays(df), cap, mismatch_days).drop("is_holiday")
    ago, out = f"hol_{mismatch_days}d_ago", f"hol_mismatch_{mismatch_days}d"
    return with_holiday_type(
        df.join(daily, DAY, "left").withColumn(out, flag(F.col("is_holiday") != F.col(ago))))
