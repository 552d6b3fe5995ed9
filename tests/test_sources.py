import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from support import at, by_key
from wattshare import schemas
from wattshare.session import shared_dir, staged, staging
from wattshare.sources import tables


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="active_kw"):
        schemas.conform(spark.createDataFrame([("a",)], "client_id string"), schemas.READINGS)


def test_nan_becomes_null_and_types_are_cast(spark):
    df = spark.createDataFrame([(at("2025-01-01 00:00"), float("nan")), (at("2025-01-01 01:00"), 2.0)],
                               "datetime_utc timestamp_ntz, value float")
    out = schemas.conform(df, schemas.HOURLY_FORECAST)
    assert out.schema["value"].dataType.typeName() == "double"
    assert sorted(r.value is None for r in out.collect()) == [False, True]


def test_zoned_stamps_become_utc_whatever_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP '2025-06-01 12:00:00 Europe/Madrid' AS datetime_utc, 1.0D AS value")
        assert schemas.conform(df, schemas.HOURLY_FORECAST).collect()[0].datetime_utc == datetime(2025, 6, 1, 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weather_keeps_one_whole_row_per_key(spark):
    rows = [("A", "p1", at("2025-01-01 00:00"), 5.0, 9.0), ("A", "p2", at("2025-01-01 00:00"), 4.0, 10.0)]
    df = spark.createDataFrame(rows, "community_code string, province string, time timestamp_ntz, temperature_2m double, cloud_cover double")
    out = tables.normalise_weather(df).collect()
    assert len(out) == 1 and (out[0].temperature_2m, out[0].cloud_cover) == (4.0, 10.0)


def test_feature_table_round_trip_prunes_by_day(spark, tmp_path):
    df = spark.createDataFrame([("A", at("2025-01-01 00:00").date(), 1.0), ("A", at("2025-01-02 00:00").date(), 2.0)],
                               "community_code string, target_date date, y double")
    target = str(tmp_path / "features")
    tables.save_features(df, target)
    tables.save_features(df, target)
    back = tables.load_features(spark, target)
    assert back.count() == 2
    pruned = tables.between_dates(back, "target_date", "2025-01-02")
    assert [r.y for r in pruned.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(target_date" in pruned._jdf.queryExecution().toString()


def test_feature_table_by_catalogue_name(spark):
    df = spark.createDataFrame([("A", at("2025-01-01 00:00").date(), 1.0)], "community_code string, target_date date, y double")
    tables.save_features(df, "features_by_name")
    assert tables.load_features(spark, "features_by_name").count() == 1
    spark.sql("DROP TABLE features_by_name")


def test_prediction_sink_overwrites(spark, tmp_path):
    target = str(tmp_path / "predictions")
    for value in (1.0, 2.0):
        tables.save_predictions(
            spark.createDataFrame([(at("2025-01-01 00:00"), value)], "datetime_15min timestamp_ntz, prediction double"), target, "us")
    rows = spark.read.parquet(target).collect()
    assert [(r.team_name, r.prediction, r.submitted_at is not None) for r in rows] == [("us", 2.0, True)]


def test_sample_is_repeatable(spark):
    df = spark.range(2000)
    one, two = (tables.bernoulli_sample(df, 0.05).count() for _ in range(2))
    assert one == two and 40 < one < 180


def test_staged_reads_back_the_same_rows_and_schema(spark):
    df = spark.range(5).withColumn("t", F.lit("2025-01-01").cast("timestamp_ntz"))
    back = staged(df, "five")
    assert back.schema.simpleString() == df.schema.simpleString() and back.count() == 5


class _Conf(dict):
    def set(self, key, value):
        self[key] = value


class _Session:
    def __init__(self, master, **conf):
        self.conf = _Conf({k.replace("__", "."): v for k, v in conf.items()})
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_dir_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(_Session("yarn", spark__checkpoint__dir="hdfs:///x")) == "hdfs:///x"


def test_shared_dir_is_never_local_on_a_cluster(tmp_path):
    for warehouse in ("/data/warehouse", "file:/data/warehouse", "warehouse"):
        with pytest.raises(RuntimeError):
            shared_dir(_Session("spark://host:7077", spark__sql__warehouse__dir=warehouse))
    assert shared_dir(_Session("yarn", spark__sql__warehouse__dir="hdfs:///w/")) == "hdfs:///w/_staged"
    assert shared_dir(_Session("local[2]", spark__sql__warehouse__dir=str(tmp_path))) == f"{tmp_path}/_staged"


def test_staged_tables_go_at_the_end_of_their_block(spark):
    with staging(spark):
        table = staged(spark.range(3), "block")
        folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert table.count() == 3 and os.path.exists(folder)
    assert not os.path.exists(folder)


def test_fuller_weather_row_wins(spark):
    rows = [("c", datetime(2024, 1, 1), None, 5.0), ("c", datetime(2024, 1, 1), 7.0, 6.0), ("c", datetime(2024, 1, 1), 8.0, 1.0)]
    df = spark.createDataFrame(rows, "community_code string, time timestamp_ntz, temperature_2m double, cloud_cover double")
    out = tables.normalise_weather(df).collect()
    assert [(r.temperature_2m, r.cloud_cover) for r in out] == [(7.0, 6.0)]


def test_rows_as_table_keys(spark):
    out = by_key(tables.rows_as_table(spark, [(0, "a"), (1, "b")], "fold int, name string"), "fold")
    assert out[1].name == "b"


def test_ranking_scan_is_pruned_and_filtered(spark, tmp_path, readings_of):
    """Only three columns are read, and the time limit reaches the Parquet reader."""
    from wattshare.operators.panel import build_panel_min, top_clients
    path = str(tmp_path / "readings")
    readings_of([("a", "N", "2025-01-01 00:00", 1.0)]).write.parquet(path)
    df = tables.load_readings(spark, path)
    scan = next(p for p in top_clients(df, 5, "2025-01-02")._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in p)
    assert "LessThan(datetime_local" in scan and "community_code" not in scan.split("ReadSchema")[1]
    plan = build_panel_min(df, unique_readings=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_fold_limits_reach_the_scan(spark, tmp_path, readings_of):
    from datetime import date as day
    from wattshare.plans.evaluation import _through
    path = str(tmp_path / "readings")
    readings_of([("a", "N", t, 1.0) for t in ("2025-01-01 22:45", "2025-01-01 23:00")]).write.parquet(path)
    df = _through(tables.load_readings(spark, path), day(2025, 1, 1))
    assert [r.datetime_local for r in df.collect()] == [at("2025-01-01 23:45")]
    assert "LessThan(datetime_local" in df._jdf.queryExecution().executedPlan().toString()
