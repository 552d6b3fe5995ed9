"""Table readers and writers.

Readers take a path or a catalogue name and never infer a schema.  Writers partition by day so
that later date ranges prune files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshare import schemas
from wattshare.functions.timegrid import as_col


def _open(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def load_readings(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """From a path, a catalogue name or a frame: readings that other jobs derive need not be stored twice."""
    return schemas.conform(_open(spark, source), schemas.READINGS)


def load_hourly_forecast(spark: SparkSession, source: str) -> DataFrame:
    """National demand forecast; PV and wind production forecasts share its layout."""
    return schemas.conform(_open(spark, source), schemas.HOURLY_FORECAST)


def load_weather(spark: SparkSession, source: str) -> DataFrame:
    return schemas.conform(
        _open(spark, source), schemas.WEATHER, optional=("province", *schemas.WEATHER_MEASURES))


def load_holidays(spark: SparkSession, source: str | DataFrame, regional: bool = False) -> DataFrame:
    """Distinct dates; with ``regional`` distinct (community_code, date), for holidays that hold in one community."""
    table = _open(spark, source)
    if regional:
        return table.select("community_code", F.col("date").cast("date").alias("date")).distinct()
    return distinct_dates(table)


def demand_as_mw(forecast: DataFrame) -> DataFrame:
    return forecast.select("datetime_utc", F.col("value").alias("D_mw"))


def distinct_dates(holidays: DataFrame) -> DataFrame:
    return holidays.select(F.col("date").cast("date").alias("date")).distinct()


def normalise_weather(weather: DataFrame) -> DataFrame:
    """One row per (community, local stamp).

    Where a key repeats the row with most known measures wins, then the smallest tuple, so reruns agree.
    """
    measures = [m for m in schemas.WEATHER_MEASURES if m in weather.columns]
    keyed = weather.drop("province")
    unknown = sum((F.col(m).isNull().cast("int") for m in measures), F.lit(0))
    if "time" in keyed.columns:
        keyed = keyed.withColumnRenamed("time", "datetime_local")
    return (
        keyed.groupBy("community_code", "datetime_local")
        .agg(F.min(F.struct(unknown.alias("_unknown"), *measures)).alias("m"))
        .select("community_code", "datetime_local", *[f"m.{m}" for m in measures])
    )


def save_features(df: DataFrame, target: str) -> None:
    """Write a feature table partitioned by target date, to a path or a catalogue name."""
    # Rebalanced by day: tasks then hold few days each, and a day too large for one task is split.
    writer = df.hint("rebalance", "target_date").write.mode("overwrite").partitionBy("target_date")
    writer.parquet(target) if "/" in target else writer.saveAsTable(target)


def save_days(df: DataFrame, path: str, day: str = "target_date") -> None:
    """Write whole days to a table partitioned by ``day``: days that ``df`` holds are replaced, all others stay.

    A rerun of one day rewrites one folder, and running it twice gives the same table.
    """
    df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, sort: Sequence[str] = ()) -> None:
    """Write a catalogue table whose rows lie in ``buckets`` by ``keys``: joins, groups and windows on these read it without an exchange."""
    rows = df.repartition(buckets, *keys)
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(name)


def load_features(spark: SparkSession, source: str) -> DataFrame:
    return _open(spark, source)


def save_predictions(predictions: DataFrame, target: str, team: str) -> None:
    """Overwrite the prediction table with (team_name, datetime_15min, prediction, submitted_at)."""
    rows = predictions.select(
        F.lit(team).alias("team_name"), "datetime_15min", "prediction",
        F.current_timestamp().alias("submitted_at"))
    writer = rows.write.mode("overwrite")
    writer.parquet(target) if "/" in target else writer.saveAsTable(target)


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """Rows whose key falls into the first ``fraction`` of all md5 values: the same rows in every run and engine."""
    limit = f"{min(2**32, round(fraction * 2**32)):08x}"
    prefix = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8)
    return df if len(limit) > 8 else df.filter(prefix < limit)


def rows_as_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A parameter list (for example fold bounds) as a table."""
    return spark.createDataFrame(list(rows), schema)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def between_dates(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows with ``start <= column < end``; either bound may be open."""
    c = as_col(column)
    if start is not None:
        df = df.filter(c >= F.lit(start).cast(df.schema[column].dataType))
    if end is not None:
        df = df.filter(c < F.lit(end).cast(df.schema[column].dataType))
    return df
