"""Two portfolios derived from the shared test tables.

``Meter``: events read as 15-minute meter readings (user = client, event type = community).
``Daily``: orders read as daily readings over several years (customer = client, market segment = community).
Demand, weather and holidays follow the stamps found in the data, so every table grows with it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshare.functions.timegrid import hour_start, slot_start

# (month, day) of the fixed-date holidays used with the daily portfolio.
FIXED_HOLIDAYS = [(1, 1), (1, 6), (3, 28), (4, 17), (4, 29), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)]
# Days of the month treated as holidays with the meter portfolio.
METER_HOLIDAYS = [1, 6, 15, 26]


class Meter:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        """One row per (client, community, slot); values below 2 count as missing."""
        slot = slot_start("ts")
        rows = self.events.select(
            F.col("user_id").cast("string").alias("client_id"), F.col("event_type").alias("community_code"),
            slot.alias("datetime_utc"), F.when(F.col("value") >= 2, F.col("value")).alias("kw"))
        return (
            rows.groupBy("client_id", "community_code", "datetime_utc").agg(F.sum("kw").alias("active_kw"))
            .withColumn("datetime_local", F.col("datetime_utc") + F.expr("INTERVAL '1' HOUR"))
        )

    @cached_property
    def raw_readings(self) -> DataFrame:
        """One row per event: a client may read several times in a slot."""
        slot = slot_start("ts")
        return self.events.select(
            F.col("user_id").cast("string").alias("client_id"), F.col("event_type").alias("community_code"),
            slot.alias("datetime_utc"), (slot + F.expr("INTERVAL '1' HOUR")).alias("datetime_local"),
            F.when(F.col("value") >= 2, F.col("value")).alias("active_kw"))

    @cached_property
    def demand(self) -> DataFrame:
        """Hourly, with a few hours at zero and a few absent."""
        h, d = F.hour("datetime_utc"), F.dayofmonth("datetime_utc")
        level = 20000.0 + 250 * F.abs(12 - h) + 40 * d + 5 * F.col("n")
        return (
            self.events.groupBy(hour_start("ts").alias("datetime_utc")).agg(F.count(F.lit(1)).alias("n"))
            .filter(~((h == 4) & d.isin(5, 14, 23)))
            .select("datetime_utc", F.when((h == 3) & d.isin(4, 13, 22), 0.0).otherwise(level).alias("value"))
        )

    @cached_property
    def generation(self) -> DataFrame:
        """A production forecast: hourly event volume."""
        return self.events.groupBy(hour_start("ts").alias("datetime_utc")).agg(F.sum("value").alias("value"))

    @cached_property
    def weather(self) -> DataFrame:
        """Per (community, local slot); some stamps absent, some repeated, some values null."""
        keys = self.events.select(
            F.col("event_type").alias("community_code"),
            (slot_start("ts") + F.expr("INTERVAL '1' HOUR")).alias("time")).distinct()
        h, d = F.hour("time"), F.dayofmonth("time")
        copies = F.when(d.isin(11, 21), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        warm = -2.0 + 1.25 * h - 0.3 * F.abs(15 - d) + 0.25 * F.length("community_code") + F.col("k")
        sun = F.when(h.between(8, 17), 60.0 * (10 - F.abs(13 - h))).otherwise(0.0)
        return keys.filter(~((h == 5) & d.isin(9, 19))).withColumn("k", F.explode(copies)).select(
            "community_code", F.concat(F.lit("P"), "community_code").alias("province"), "time",
            F.when(~((h == 7) & (d == 8)), warm).alias("temperature_2m"),
            (warm - 1.5).alias("apparent_temperature"),
            (40.0 + 2 * F.abs(12 - h)).alias("relative_humidity_2m"),
            F.when(d.isin(3, 7, 12, 20), 0.2 * h).otherwise(0.0).alias("precipitation"),
            (3.0 * d + h).alias("cloud_cover"),
            (5.0 + 0.5 * F.abs(6 - h)).alias("wind_speed_10m"),
            sun.alias("shortwave_radiation"), (sun / 2).alias("diffuse_radiation"),
            F.when(h.between(8, 17), 1).otherwise(0).alias("is_day"))

    @cached_property
    def regional_holidays(self) -> DataFrame:
        """Days of a community's own: its name's length decides which."""
        local = F.col("ts") + F.expr("INTERVAL '1' HOUR")
        own = F.dayofmonth(local) % (F.length("event_type") + 3) == 0
        return self.events.filter(own).select(F.col("event_type").alias("community_code"), F.to_date(local).alias("date"))

    @cached_property
    def holidays(self) -> DataFrame:
        """Repeated dates on purpose: one row per event of a holiday."""
        local = F.col("ts") + F.expr("INTERVAL '1' HOUR")
        return self.events.filter(F.dayofmonth(local).isin(METER_HOLIDAYS)).select(F.to_date(local).alias("date"))


class Daily:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def orders(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/orders.parquet").select(
            "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("day"))

    @cached_property
    def readings(self) -> DataFrame:
        customer = self.spark.read.parquet(f"{self.sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
        priced = F.when(F.col("o_totalprice") >= 2000, F.col("o_totalprice"))
        return (
            self.orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("o_custkey").cast("string").alias("client_id"), F.col("c_mktsegment").alias("community_code"),
                     F.col("day").alias("datetime_utc"))
            .agg(F.sum(priced).alias("active_kw"))
            .withColumn("datetime_local", F.col("datetime_utc"))
        )

    @cached_property
    def demand(self) -> DataFrame:
        return self.orders.groupBy(F.col("day").alias("datetime_utc")).agg(F.count(F.lit(1)).alias("n")).select(
            "datetime_utc", (20000.0 + 10 * F.col("n") + F.dayofyear("datetime_utc")).alias("value"))

    @cached_property
    def holidays(self) -> DataFrame:
        code = F.month("day") * 100 + F.dayofmonth("day")
        return self.orders.filter(code.isin([m * 100 + d for m, d in FIXED_HOLIDAYS])).select(
            F.to_date("day").alias("date"))
