"""Registered queries against their SQL in DuckDB.

The default list touches every module; ``WATTSHARE_ALL=1`` runs all of them.
"""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from support import DATA
from wattshare.catalog.base import REGISTRY

USUAL = [
    "weather_scan_s4_p13", "prediction_sink_s7", "fold_rows_table_s9", "grid_gaps_j10_q8", "trailing_week_std_w3",
    "holiday_lag_lead_w6_o18", "panel_from_unchecked_readings_a2", "lift_pivot_a17", "winter_error_a26", "alpha_dataset_week_history_o9",
    "short_dataset_o9", "walk_forward_entity_o25", "walk_forward_pooled_o26", "blend_sweep_o27", "score_horizon_o29",
    "cross_validation_o30", "fourier_week_bins_o6c", "lookup_back_j17_q3", "correlations_a22", "panel_check_q1", "snapshot_check_q4",
    "calendar_check_altered_q5", "leakage_check_q7", "time_shifted_self_join_j6", "cross_validation_raw_o30", "regional_holidays_o7",
    "rolling_block_w9", "score_boosted_o29", "bernoulli_sample_p14", "generation_scan_s5",
]
CHOSEN = list(REGISTRY) if os.environ.get("WATTSHARE_ALL") else USUAL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in entry.oracle_sql():
        return
    want = db.execute(entry.oracle_sql()[name])
    assert [d[0] for d in want.description] == df.columns
    assert Counter(map(repr, rows)) == Counter(map(repr, want.fetchall()))


def test_every_query_names_what_it_covers():
    assert all(q.covers for q in REGISTRY.values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
