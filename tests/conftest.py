import os
import sys
from datetime import timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from support import at  # noqa: E402

from wattshare import schemas  # noqa: E402
from wattshare.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "wattshare-tests", "local[4]", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def readings_of(spark):
    """Readings from (client, community, utc text, kw); local time is UTC + 1 h."""
    def make(rows):
        full = [(c, g, at(t), at(t) + timedelta(hours=1), kw) for c, g, t, kw in rows]
        return spark.createDataFrame(full, schemas.READINGS)
    return make


@pytest.fixture
def demand_of(spark):
    def make(rows):
        return spark.createDataFrame([(at(t), v) for t, v in rows], schemas.HOURLY_FORECAST)
    return make


@pytest.fixture
def shares_of(spark):
    """A share table on an hourly or finer grid: (community, utc datetime, alpha, n_clients)."""
    def make(rows, offset_hours=1):
        full = [(g, t, t + timedelta(hours=offset_hours), a, n, (t + timedelta(hours=offset_hours)).date()) for g, t, a, n in rows]
        return spark.createDataFrame(
            full, "community_code string, datetime_utc timestamp_ntz, datetime_local timestamp_ntz, alpha double, "
                  "n_clients bigint, target_date date")
    return make
