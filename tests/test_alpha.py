import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from support import at, by_key
from wattshare.functions.timegrid import hour_start, utc_to_local
from wattshare.operators import alpha as A
from wattshare.operators import quality as Q

START = datetime(2025, 3, 1)


@pytest.fixture
def history(shares_of):
    """Two communities over 16 days of quarter hours with random holes and unknown shares."""
    rng = random.Random(7)
    rows = []
    for code in ("N", "S"):
        for i in range(16 * 96):
            if rng.random() < 0.15:
                continue
            alpha = None if rng.random() < 0.1 else rng.uniform(1, 2)
            rows.append((code, START + timedelta(minutes=15 * i), alpha, rng.randint(1, 9)))
    return rows, shares_of(rows).cache()


def test_zero_missing_and_repeated_demand(readings_of, demand_of):
    from wattshare.operators.panel import build_panel
    panel = build_panel(readings_of([("a", "N", f"2025-01-01 0{h}:15", 6.0) for h in range(3)]))
    demand = demand_of([("2025-01-01 00:00", 0.0), ("2025-01-01 02:00", 2.0), ("2025-01-01 02:30", 4.0)])
    rows = by_key(A.with_alpha(panel, demand), "datetime_utc")
    assert len(rows) == 3
    assert rows[at("2025-01-01 00:15")].alpha is None and rows[at("2025-01-01 01:15")].D_mw is None
    assert rows[at("2025-01-01 02:15")].D_mw == 3.0 and rows[at("2025-01-01 02:15")].alpha == 2.0


def test_exact_demand_join(readings_of, demand_of):
    from wattshare.operators.panel import build_panel
    panel = build_panel(readings_of([("a", "N", "2025-01-01 00:00", 6.0), ("a", "N", "2025-01-01 00:15", 6.0)]))
    rows = by_key(A.with_alpha(panel, demand_of([("2025-01-01 00:00", 3.0)]), exact=True), "datetime_utc")
    assert rows[at("2025-01-01 00:00")].alpha == 2.0 and rows[at("2025-01-01 00:15")].alpha is None


def test_window_lag_equals_self_join_and_lookup(history):
    rows, df = history
    known = {(c, t): a for c, t, a, _ in rows}
    windowed = A.with_alpha_lags(df, (2, 7))
    joined = A.with_lag_join(df, "alpha", 7, "j7")
    for r in windowed.collect():
        assert r.alpha_lag_2d == known.get((r.community_code, r.datetime_utc - timedelta(days=2)))
        assert r.alpha_lag_7d == known.get((r.community_code, r.datetime_utc - timedelta(days=7)))
    a = {(r.community_code, r.datetime_utc): r.alpha_lag_7d for r in windowed.collect()}
    assert a == {(r.community_code, r.datetime_utc): r.j7 for r in joined.collect()}
    assert all(r.violations == 0 for r in Q.check_lags(windowed, df, (2, 7)).collect())
    wrong = windowed.withColumn("alpha_lag_2d", F.col("alpha"))
    assert by_key(Q.check_lags(wrong, df, (2, 7)), "rule")["alpha_lag_2d"].violations > 1000


def test_all_lags_share_one_shuffle(history):
    plan = A.with_alpha_lags(history[1].select("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    executed = A.with_alpha_lags(history[1])._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1


def test_positional_lag_differs_once_a_slot_is_missing(shares_of):
    full = [("N", START + timedelta(minutes=15 * i), float(i), 1) for i in range(300)]
    def both(rows):
        df = A.with_lags(shares_of(rows), {"exact": ("alpha", 2)})
        return A.positional_lag(df, "alpha", 192, "rows").collect()
    assert all(r.exact == r.rows for r in both(full))
    assert any(r.exact != r.rows for r in both(full[:50] + full[51:]))


def test_short_lags_are_refused(history):
    for days in ((1, 7), ()):
        with pytest.raises(ValueError):
            A.with_alpha_lags(history[1], days)


def _frame(rows, code, t, seconds):
    return [a for c, u, a, _ in rows if c == code and a is not None and 0 <= (t - u).total_seconds() < seconds]


def test_trailing_statistics_against_brute_force(history):
    rows, df = history
    out = A.trailing_stats(df, "alpha", {"m": ("mean", 86_400), "s": ("std", 2 * 86_400)}).collect()
    assert len(out) == len(rows)
    for r in out[::37]:
        day, two = (_frame(rows, r.community_code, r.datetime_utc, s) for s in (86_400, 172_800))
        assert r.m == pytest.approx(statistics.mean(day)) if day else r.m is None
        assert r.s == pytest.approx(statistics.stdev(two)) if len(two) > 1 else r.s is None


def test_trailing_statistics_hold_across_every_block_edge(shares_of):
    # Frames of two hours make blocks of eight, so ten days cross thirty edges.
    rows = [("N", START + timedelta(minutes=15 * i), float(i % 11), 1) for i in range(960)]
    for r in A.trailing_stats(shares_of(rows), "alpha", {"m": ("mean", 7200)}).collect():
        assert r.m == pytest.approx(statistics.mean(_frame(rows, "N", r.datetime_utc, 7200)))


def test_snapshot_against_brute_force(history):
    rows, df = history
    snap = by_key(A.cutoff_snapshot(df), "community_code", "target_date")
    cutoffs = [(c, t, a, n) for c, t, a, n in rows if (t.hour, t.minute) == (10, 45)]
    assert len(snap) == len(cutoffs)
    for c, t, a, n in cutoffs:
        r = snap[c, (t + timedelta(days=1)).date()]
        week, day = _frame(rows, c, t, 7 * 86_400), _frame(rows, c, t, 86_400)
        assert (r.sn_alpha_last, r.n_clients_at_cutoff) == (a, n)
        assert r.sn_alpha_mean_7d == pytest.approx(statistics.mean(week))
        assert r.sn_alpha_mean_24h == pytest.approx(statistics.mean(day))
        if len(week) > 1:
            assert r.sn_alpha_std_7d == pytest.approx(statistics.stdev(week))
    counts = by_key(A.client_count_snapshot(df), "community_code", "target_date")
    assert {k: v.n_clients_at_cutoff for k, v in counts.items()} == {k: v.n_clients_at_cutoff for k, v in snap.items()}
    attached = A.attach_snapshot(df, A.cutoff_snapshot(df))
    assert all(r.violations == 0 for r in Q.check_snapshot(attached, df).collect())


def test_cutoff_shown_twice_by_the_clock_gives_one_row(shares_of, spark):
    df = shares_of([("N", datetime(2025, 10, 26, 0, 45), 1.0, 1), ("N", datetime(2025, 10, 26, 1, 45), 2.0, 2)], 0)
    df = df.withColumn("datetime_local", utc_to_local("datetime_utc"))
    rows = A.cutoff_snapshot(df, cutoff_hour=3).collect()
    assert [(r.sn_alpha_last, r.n_clients_at_cutoff) for r in rows] == [(2.0, 2)]


def test_same_weekday_mean(shares_of):
    rows = [("N", START + timedelta(days=i), float(i), 1) for i in range(40)]
    out = {r.datetime_utc: r.m for r in A.same_dow_mean(shares_of(rows), "alpha", "m", 28).collect()}
    assert out[START + timedelta(days=35)] == statistics.mean([7, 14, 21, 28])
    assert out[START + timedelta(days=3)] is None


def test_clock_change_days_have_92_and_100_slots_and_exact_lags(shares_of, spark):
    for day, slots in ((datetime(2025, 3, 30), 92), (datetime(2025, 10, 26), 100)):
        rows = [("N", day - timedelta(days=3) + timedelta(minutes=15 * i), float(i), 1) for i in range(6 * 96)]
        df = shares_of(rows).withColumn("datetime_local", utc_to_local("datetime_utc"))
        assert df.filter(F.to_date("datetime_local") == F.lit(day.date())).count() == slots
        lagged = A.with_lags(df, {"l": ("alpha", 2)}).filter(F.col("l").isNotNull())
        assert lagged.filter(F.col("alpha") - F.col("l") != 192).count() == 0 and lagged.count() == 4 * 96


@pytest.mark.parametrize("zone", ["UTC", "Europe/Madrid", "America/New_York"])
def test_hour_start_ignores_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2025-03-30 02:37:12.5' AS t")
        assert df.select(hour_start("t")).collect()[0][0] == datetime(2025, 3, 30, 2)
        lagged = spark.sql("SELECT 'N' community_code, explode(sequence(TIMESTAMP_NTZ '2025-03-28 00:00:00', "
                           "TIMESTAMP_NTZ '2025-04-01 00:00:00', INTERVAL '1' HOUR)) datetime_utc").withColumn("v", F.monotonically_increasing_id())
        assert A.with_lags(lagged, {"l": ("v", 2)}).filter(F.col("v") - F.col("l") != 48).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_robust_lag(spark):
    rows = [(None, 1.0, 3.0, None), (5.0, None, None, None), (None,) * 4, (4.0, 1.0, 9.0, None), (4.0, 1.0, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [r.m for r in A.robust_lag(df, ["a", "b", "c", "d"], "m").collect()] == [2.0, 5.0, None, 4.0, 3.0]
