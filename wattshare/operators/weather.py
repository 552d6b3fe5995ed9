"""Weather forecast attributes and what is derived from temperature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshare.functions.rowwise import clip, flag
from wattshare.schemas import WEATHER_MEASURES
from wattshare.sources.tables import normalise_weather

# Comfort limits in degrees Celsius and the evening hours, both ends included.
HEATING_MILD, HEATING = 15.0, 18.0
COOLING = 22.0
EVENING = (18, 23)


def attach_weather(
    panel: DataFrame, weather: DataFrame | None, measures: Sequence[str] = tuple(WEATHER_MEASURES),
) -> DataFrame:
    """Join the forecast on (community, local stamp); measures the source lacks are left out."""
    if weather is None:
        return panel
    present = [m for m in measures if m in weather.columns]
    keys = ["community_code", "datetime_local"]
    side = normalise_weather(weather.select("community_code", *(
        c for c in ("time", "datetime_local") if c in weather.columns), *present))
    return panel.join(side, keys, "left").select(*panel.columns, *present)


def with_degree_days(df: DataFrame) -> DataFrame:
    """Heating need below 15 and 18 degrees, cooling need above 22."""
    t = F.col("temperature_2m")
    return df.withColumns({
        "hdd15": clip(F.lit(HEATING_MILD) - t, lower=0.0),
        "hdd18": clip(F.lit(HEATING) - t, lower=0.0),
        "cdd22": clip(t - F.lit(COOLING), lower=0.0),
    })


def with_temp_interactions(df: DataFrame) -> DataFrame:
    evening = flag(F.col("hour").between(*EVENING))
    return df.withColumns({
        "temp_x_hour": F.col("temperature_2m") * F.col("hour"),
        "temp_x_weekend": F.col("temperature_2m") * F.col("is_weekend"),
        "hdd_x_evening": F.col("hdd18") * evening,
    })
