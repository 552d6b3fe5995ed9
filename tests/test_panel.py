import math

import pytest
from pyspark.sql import functions as F

from support import at, by_key
from wattshare.operators import panel as P
from wattshare.operators import quality as Q

T0, T1 = "2025-01-01 00:00", "2025-01-01 00:15"


@pytest.fixture
def readings(readings_of):
    return readings_of([
        ("a", "N", T0, 1.0), ("b", "N", T0, 3.0), ("c", "N", T0, None),
        ("a", "N", T1, None), ("b", "N", T1, None), ("d", "N", T1, None),
        ("a", "S", T0, 7.0),
    ])


@pytest.mark.parametrize("unique", [True, False])
def test_statistics_and_counts(readings, unique):
    rows = by_key(P.build_panel(readings, unique_readings=unique), "community_code", "datetime_utc")
    r = rows["N", at(T0)]
    assert (r.n_clients, r.n_missing, r.n_reporting, r.n_new_clients) == (3, 1, 2, 3)
    assert (r.total_kw, r.mean_kw, r.min_kw, r.max_kw) == (4.0, 2.0, 1.0, 3.0)
    assert r.std_kw == pytest.approx(math.sqrt(2)) and r.median_kw == 1.0
    assert r.avg_kw_per_client == pytest.approx(4 / 3) and r.avg_kw_reporting == 2.0
    assert r.datetime_local == at("2025-01-01 01:00")


@pytest.mark.parametrize("unique", [True, False])
def test_all_null_slot_has_null_total(readings, unique):
    r = by_key(P.build_panel(readings, unique_readings=unique), "community_code", "datetime_utc")["N", at(T1)]
    assert r.total_kw is None and r.avg_kw_reporting is None and r.n_reporting == 0
    assert r.n_clients == 3 and r.n_new_clients == 1


def test_one_client_has_no_deviation(readings):
    r = by_key(P.build_panel(readings), "community_code", "datetime_utc")["S", at(T0)]
    assert r.std_kw is None and r.n_new_clients == 1


def test_repeated_readings_count_clients_once(readings_of):
    df = readings_of([("a", "N", T0, 1.0), ("a", "N", T0, 2.0), ("b", "N", T0, 4.0), ("a", "N", T1, 1.0)])
    rows = by_key(P.build_panel(df), "datetime_utc")
    assert rows[at(T0)].n_clients == 2 and rows[at(T0)].total_kw == 7.0
    # First readings are counted as rows, so the repeated one counts twice.
    assert rows[at(T0)].n_new_clients == 3 and rows[at(T1)].n_new_clients == 0
    assert by_key(P.build_panel_min(df), "datetime_utc")[at(T0)].n_clients == 2
    assert [tuple(r)[2:] for r in P.duplicate_readings(df).collect()] == [("a", 2)]


def test_new_only_where_the_client_first_appears(readings_of):
    df = readings_of([("a", "N", T1, 1.0), ("a", "S", T0, 1.0), ("b", "S", T1, 1.0)])
    rows = by_key(P.build_panel(df, unique_readings=True), "community_code", "datetime_utc")
    assert rows["N", at(T1)].n_new_clients == 0
    assert rows["S", at(T0)].n_new_clients == 1 and rows["S", at(T1)].n_new_clients == 1


def test_panel_agrees_with_row_level_flags(readings):
    flagged = P.with_new_flag(readings).groupBy("community_code", "datetime_utc").agg(F.sum("is_new").alias("n"))
    panel = P.build_panel(readings).select("community_code", "datetime_utc", F.col("n_new_clients").alias("n"))
    assert sorted(map(tuple, flagged.collect())) == sorted(map(tuple, panel.collect()))


def test_top_clients_breaks_ties_and_skips_nobody(readings_of):
    df = readings_of([("b", "N", T0, 5.0), ("a", "N", T0, 2.0), ("a", "S", T0, 3.0), ("c", "N", T0, 1.0), ("d", "N", T0, None)])
    assert [r.client_id for r in P.top_clients(df, 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        P.top_clients(df, 0)


def test_reclassified_client_in_two_communities_keeps_each_reading_once(readings_of):
    df = readings_of([("a", "N", T0, 9.0), ("a", "S", T0, 9.0), ("b", "N", T0, 1.0)])
    out = P.reclassify_large_clients(df, 1)
    assert sorted(r.community_code for r in out.collect()) == ["BIG_a", "BIG_a", "N"]
    for unique in (True, False):
        assert by_key(P.build_panel_min(out, unique), "community_code")["BIG_a"].n_clients == 1
        assert by_key(P.build_panel(out, unique), "community_code")["BIG_a"].n_clients == 1


def test_ranking_ignores_readings_from_the_horizon(readings_of):
    df = readings_of([("a", "N", "2025-01-01 10:00", 5.0), ("b", "N", "2025-01-01 10:00", 1.0), ("b", "N", "2025-01-02 10:00", 99.0)])
    names = {r.community_code for r in P.reclassify_large_clients(df, 1, fit_until="2025-01-02").collect()}
    assert names == {"BIG_a", "N"}


def test_null_rate_and_check(readings):
    panel = P.build_panel(readings, unique_readings=True)
    rate = by_key(P.null_rate(panel), "community_code")
    assert rate["N"].null_pct == pytest.approx(100 * 4 / 6) and rate["S"].null_pct == 0
    assert all(r.violations == 0 for r in Q.check_panel(readings, panel).collect())
    broken = panel.withColumn("total_kw", F.col("total_kw") + 1)
    assert by_key(Q.check_panel(readings, broken), "rule")["total_kw"].violations == 2


def test_gaps_and_continuity(readings_of):
    df = readings_of([("a", "N", t, 1.0) for t in ("2025-01-01 23:30", "2025-01-02 00:15", "2025-01-03 00:00")])
    panel = P.build_panel_min(df, unique_readings=True)
    c = Q.continuity(panel).collect()[0]
    assert (c.actual_rows, c.expected_rows, c.internal_gaps) == (3, 99, 96)
    gaps = Q.grid_gaps(panel)
    assert gaps.count() == 96 and gaps.agg(F.min("datetime_utc")).collect()[0][0] == at("2025-01-01 23:45")
    assert Q.slot_grid(panel).count() == Q.slot_grid(panel).distinct().count() == 99


def test_unique_panel_moves_only_combined_rows(readings):
    """The readings are never shuffled per client and slot when they are known to be unique."""
    plan = P.build_panel(readings, unique_readings=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(community_code#" in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert not ("client_id" in line and "datetime_utc" in line), line


def test_panel_reads_readings_once(readings):
    """Beside the client numbers, which are stored, statistics, distinct clients and new ones come of one scan."""
    plan = P.build_panel(readings)._jdf.queryExecution().optimizedPlan()
    leaves = [plan.collectLeaves().apply(i).nodeName() for i in range(plan.collectLeaves().size())]
    assert len(leaves) == 2 and sum("LogicalRelation" in n or "Relation" in n and "parquet" in n.lower() for n in leaves) == 1


def test_row_flags_do_not_gather_a_client_in_one_task(readings):
    plan = P.with_new_flag(readings)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "client_id" in join and "datetime_utc" in join
