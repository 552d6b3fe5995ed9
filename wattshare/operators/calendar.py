"""Calendar, Fourier and daylight features from the local wall clock."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshare.functions.rowwise import clip, flag

TAU = 2 * math.pi

# Slots per day, days per week, the two year lengths in use, and the solar declination
# (amplitude in radians, day of the spring equinox).
SLOTS_PER_DAY = 96
DAYS_PER_WEEK = 7
LEAP_YEAR_DAYS = 366
MEAN_YEAR_DAYS = 365.25
DECLINATION_AMPLITUDE = 0.4093
EQUINOX_DAY = 81


def _circle(phase: Column, period: float) -> tuple[Column, Column]:
    angle = phase * F.lit(TAU / period)
    return F.sin(angle), F.cos(angle)


def with_calendar(df: DataFrame, style: str = "clock", ts: str = "datetime_local") -> DataFrame:
    """Calendar columns in one of two layouts.

    ``clock``: hour, quarter of the hour, slot of day ``mod``, weekday with Sunday = 1.
    ``cyclic``: slot of day as ``qhour``, weekday with Monday = 0, day of month, yearly cycle.
    """
    t = F.col(ts)
    quarter = F.floor(F.minute(t) / 15).cast("int")
    slot = F.hour(t) * 4 + quarter
    if style == "clock":
        dow = F.dayofweek(t)
        sin_mod, cos_mod = _circle(slot, SLOTS_PER_DAY)
        sin_dow, cos_dow = _circle(dow, DAYS_PER_WEEK)
        return df.withColumns({
            "hour": F.hour(t), "qhour": quarter, "mod": slot, "dow": dow,
            "month": F.month(t), "doy": F.dayofyear(t), "is_weekend": flag(dow.isin(1, 7)),
            "sin_mod": sin_mod, "cos_mod": cos_mod, "sin_dow": sin_dow, "cos_dow": cos_dow,
        })
    if style == "cyclic":
        dow, doy = F.weekday(t), F.dayofyear(t)
        circles = {"qhour": _circle(slot, SLOTS_PER_DAY), "dow": _circle(dow, DAYS_PER_WEEK), "doy": _circle(doy, LEAP_YEAR_DAYS)}
        return df.withColumns({
            "qhour": slot, "dow": dow, "dom": F.dayofmonth(t), "doy": doy, "month": F.month(t),
            "is_weekend": flag(dow >= 5),
            **{f"sin_{name}": pair[0] for name, pair in circles.items()},
            **{f"cos_{name}": pair[1] for name, pair in circles.items()},
        })
    raise ValueError(f"unknown calendar style: {style}")


def with_fourier(df: DataFrame, harmonics: Sequence[int] = (1, 2, 3, 4), period: float = MEAN_YEAR_DAYS) -> DataFrame:
    """Yearly harmonics ``sin_doy_k`` and ``cos_doy_k``."""
    pairs = {k: _circle(F.col("doy") * k, period) for k in harmonics}
    return df.withColumns({
        **{f"sin_doy_{k}": p[0] for k, p in pairs.items()}, **{f"cos_doy_{k}": p[1] for k, p in pairs.items()}})


def with_week_bins(df: DataFrame) -> DataFrame:
    """Hour and quarter hour counted through the week."""
    return df.withColumns({
        "hour_of_week": F.col("dow") * 24 + F.col("hour"), "qhour_of_week": F.col("dow") * SLOTS_PER_DAY + F.col("mod")})


def with_daylight(df: DataFrame, latitude: float = 40.0) -> DataFrame:
    """Hours between sunrise and sunset at ``latitude``, from the day of year."""
    declination = F.lit(DECLINATION_AMPLITUDE) * F.sin((F.col("doy") - EQUINOX_DAY) * F.lit(TAU / MEAN_YEAR_DAYS))
    cosine = clip(F.lit(-math.tan(math.radians(latitude))) * F.tan(declination), -1.0, 1.0)
    return df.withColumn("daylight_h", F.lit(24.0) * F.acos(cosine) / F.pi())
