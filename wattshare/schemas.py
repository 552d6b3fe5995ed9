"""Input schemas and the check applied when a table is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("client_id", T.StringType(), False),
    T.StructField("community_code", T.StringType(), False),
    T.StructField("datetime_utc", T.TimestampNTZType(), False),
    T.StructField("datetime_local", T.TimestampNTZType(), False),
    T.StructField("active_kw", T.DoubleType(), True),
])

HOURLY_FORECAST = T.StructType([
    T.StructField("datetime_utc", T.TimestampNTZType(), False),
    T.StructField("value", T.DoubleType(), True),
])

HOLIDAYS = T.StructType([T.StructField("date", T.DateType(), False)])

WEATHER_MEASURES = [
    "temperature_2m", "apparent_temperature", "relative_humidity_2m", "precipitation",
    "cloud_cover", "wind_speed_10m", "shortwave_radiation", "diffuse_radiation", "is_day",
]

# The forecast run issued two days ahead carries only these measures.
WEATHER_MEASURES_D2 = [
    "temperature_2m", "apparent_temperature", "relative_humidity_2m",
    "shortwave_radiation", "cloud_cover", "wind_speed_10m",
]

WEATHER = T.StructType(
    [
        T.StructField("community_code", T.StringType(), False),
        T.StructField("province", T.StringType(), True),
        T.StructField("time", T.TimestampNTZType(), False),
    ]
    + [T.StructField(m, T.IntegerType() if m == "is_day" else T.DoubleType(), True) for m in WEATHER_MEASURES]
)


def conform(df: DataFrame, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto ``schema``: check presence, cast, and turn NaN into NULL.

    Zoned timestamps become UTC wall-clock ``TIMESTAMP_NTZ`` whatever the session zone is.
    Columns named in ``optional`` may be absent; any other absent column is an error.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have and f.name not in optional]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = []
    for field in schema.fields:
        if field.name not in have:
            continue
        col, have_type = F.col(field.name), have[field.name]
        if isinstance(field.dataType, T.TimestampNTZType) and isinstance(have_type, T.TimestampType):
            col = F.convert_timezone(None, F.lit("UTC"), col)
        elif have_type != field.dataType:
            col = col.cast(field.dataType)
        if isinstance(have_type, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(F.col(field.name)), col)
        out.append(col.alias(field.name))
    return df.select(*out)
