"""Inputs that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattshare.catalog.sql import FOLDS, METER_MIN_ROWS
from wattshare.operators.holidays import with_holiday_flag
from wattshare.operators.panel import build_panel
from wattshare.plans.dataset import build_alpha_dataset, shares
from wattshare.plans.evaluation import walk_forward
from wattshare.sources.fixtures import Daily, Meter

WEEK = 7


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(Meter(spark, sf_dir).readings, unique_readings=True)


def base(spark: SparkSession, sf_dir: str, stage: bool = False) -> DataFrame:
    m = Meter(spark, sf_dir)
    return shares(m.readings, m.demand, unique_readings=True, stage=stage)


def dataset(spark: SparkSession, sf_dir: str, min_days: int = WEEK) -> DataFrame:
    m = Meter(spark, sf_dir)
    return build_alpha_dataset(
        m.readings, m.demand, m.weather, m.holidays, min_history_days=min_days, unique_readings=True)


def oof(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    return walk_forward(dataset(spark, sf_dir), FOLDS, pooled, METER_MIN_ROWS)


def base_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Daily(spark, sf_dir)
    return with_holiday_flag(shares(d.readings, d.demand, unique_readings=True), d.holidays)
