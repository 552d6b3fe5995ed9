"""Mechanisms for long histories and many entities, against plain Python."""

import math
import random
import statistics
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import at, by_key, days, steady
from wattshare.functions.moments import mean_of, merged, moments, std_of
from wattshare.operators import alpha as A
from wattshare.operators import first_seen as S
from wattshare.operators import model as M
from wattshare.operators import panel as P
from wattshare.operators import quality as Q
from wattshare.operators.baseline import with_reversion
from wattshare.operators.diagnostics import association_importance
from wattshare.operators.linear import LinearL1, solved
from wattshare.operators.quantiles import exact_quantiles
from wattshare.operators.validation import assign_fold_table
from wattshare.sources import tables

READINGS = "client_id string, community_code string, datetime_utc timestamp_ntz, datetime_local timestamp_ntz, active_kw double"


# Linear learner


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_small_systems_are_solved(spark, size):
    rng = np.random.default_rng(size)
    rows = []
    for i in range(20):
        a = rng.normal(size=(size + 3, size))
        g, b = a.T @ a, rng.normal(size=size)
        rows.append((i, np.c_[g, b].tolist(), np.linalg.solve(g, b).tolist()))
    got = spark.createDataFrame(rows, "i int, m array<array<double>>, want array<double>").select(
        "want", solved(F.col("m"), size).alias("got")).collect()
    assert all(r.got == pytest.approx(r.want, rel=1e-6, abs=1e-9) for r in got)


def best_line(points):
    """Least sum of absolute errors: some best line passes through two of the points."""
    lines = [((y2 - y1) / (x2 - x1), y1 - (y2 - y1) / (x2 - x1) * x1) for (x1, y1), (x2, y2) in combinations(points, 2) if x1 != x2]
    lines += [(0.0, y) for _, y in points]
    return min(sum(abs(y - a * x - b) for x, y in points) for a, b in lines)


def test_absolute_error_is_the_least(spark):
    rng, rows, points = random.Random(2), [], defaultdict(list)
    for fold, code, n in ((0, "N", 40), (0, "S", 31), (1, "N", 60), (1, "T", 7)):
        for _ in range(n):
            x = rng.uniform(-3, 9)
            y = 2.0 * fold + (1.5 if code == "N" else -0.7) * x + rng.choice([0, 0, 0, 1, -1, 40]) * rng.random()
            rows.append((fold, code, x, y))
            points[fold, code].append((x, y))
    df = spark.createDataFrame(rows, "fold int, code string, x double, y double")
    model = LinearL1(["x"], passes=25, min_rows=10).fit(df, "y", ["fold", "code"])
    loss = Counter()
    for r in model.predict(df).collect():
        loss[r.fold, r.code] += abs(r.y - r.correction)
    for key, p in points.items():
        if len(p) >= 10:
            assert loss[key] <= 1.002 * best_line(p) + 1e-9, key
    assert all(r.correction == 0 for r in model.predict(df).filter("code = 'T'").collect())
    lines = {(r.fold, r.code): {} for r in model.coefficients().collect()}
    for r in model.coefficients().collect():
        lines[r.fold, r.code][r.feature] = r.coefficient
    assert lines[0, "N"]["x"] == pytest.approx(1.5, abs=0.05) and lines[1, "N"]["(intercept)"] == pytest.approx(2.0, abs=0.6)


def test_linear_learner_with_odd_columns(spark):
    """Unknown values count as the mean, constant and absent columns as nothing, unknown targets and weights not at all."""
    rows = [("N", float(i % 7), None if i % 5 == 0 else float(i), 4.0, float(3 * (i % 7)), 1.0) for i in range(60)]
    rows += [("N", 1.0, 1.0, 4.0, None, 1.0), ("N", 1.0, 1.0, 4.0, 1e9, None), ("N", 1.0, 1.0, 4.0, 1e9, 0.0), ("Z", None, None, None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "code string, x double, z double, c double, y double, w double")
    model = LinearL1(["x", "z", "c", "absent"], weight="w", min_rows=1).fit(df, "y", ["code"])
    got = model.predict(df).collect()
    assert all(r.correction == pytest.approx(3 * r.x, abs=1e-3) for r in got if r.code == "N")
    assert [r.correction for r in got if r.code == "Z"] == [pytest.approx(5.0)]
    weights = {(r.code, r.feature): r.weight for r in model.importance().collect()}
    assert weights["N", "x"] > 0.99 and weights["N", "c"] == 0 and weights["Z", "x"] == 0
    with pytest.raises(ValueError):
        LinearL1(["x"], passes=0).fit(df, "y", ["code"])


def test_linear_learner_runs_a_fixed_number_of_jobs(spark):
    """As many jobs for three hundred entities as for three."""
    def jobs(n):
        rows = [(f"e{i % n}", float(i % 11), float(i % 13)) for i in range(900)]
        df = spark.createDataFrame(rows, "code string, x double, y double")
        spark.sparkContext.setJobGroup(f"linear-{n}", "fit")
        LinearL1(["x"], passes=3).fit(df, "y", ["code"])
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"linear-{n}"))
        spark.sparkContext.setJobGroup("", "")
        return found
    assert jobs(3) == jobs(300)


def test_reversion_and_association(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0, 1.0), ("a", 0.0, 1.0, 2.0), ("a", None, 1.0, 3.0), ("b", 1.0, 0.0, 4.0)],
                               "community_code string, level double, alpha_lag_7d double, y double")
    got = [r.rev_level for r in with_reversion(df, ["level"]).collect()]
    assert got == [pytest.approx(math.log(2)), None, None, None]
    weights = {(r.community_code, r.feature): r.weight for r in association_importance(df, ["level", "alpha_lag_7d"], "y").collect()}
    assert weights["a", "level"] == pytest.approx(1.0) and weights["a", "alpha_lag_7d"] == 0 and weights["b", "level"] == 0


def test_each_fold_stops_by_its_own_last_days(spark, monkeypatch):
    rows = [(f, "N", date(2025, 1, 1) + timedelta(days=i), float(i), float(i)) for f, n in ((0, 10), (1, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "fold int, community_code string, target_date date, x double, y double")
    asked = {}

    def record(own, target, numeric, categorical, stage, **options):
        asked[own.first()["fold"]] = options["stop_date"]
        return None
    monkeypatch.setattr(M, "fit_gbt", record)
    M.Boosted(["x"], stop_days=3).fit(df, "y", ["fold"])
    assert asked == {0: "2025-01-08", 1: "2025-01-18"}


# Client bitmaps


def messy_readings(spark, seed=1, clients=700):
    rng, rows = random.Random(seed), []
    for _ in range(6000):
        c = None if rng.random() < 0.02 else f"c{int(clients * rng.random() ** 2)}"
        t = datetime(2025, 1, 1) + timedelta(minutes=15 * rng.randrange(60 if rng.random() < 0.5 else 300))
        kw = None if rng.random() < 0.1 else round(rng.uniform(0, 50), 2)
        rows.append((c, rng.choice(["N", "N", "N", "S", None]), t, t + timedelta(hours=1), kw))
    return rows + rows[:500], spark.createDataFrame(rows + rows[:500], READINGS)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_panel_of_repeated_readings(spark, monkeypatch, limit):
    """Numbers broadcast and shuffled; more clients than a block holds, rows without client, community or value."""
    monkeypatch.setattr(P, "NUMBERED_ROWS", limit)
    rows, df = messy_readings(spark)
    first, cells = {}, defaultdict(list)
    for c, g, t, _, kw in rows:
        cells[g, t].append((c, kw))
        if c is not None:
            first[c] = min(first.get(c, t), t)
    got = by_key(P.build_panel(df), *P.KEYS)
    least = by_key(P.build_panel_min(df), *P.KEYS)
    assert set(got) == set(cells) == set(least) and len(first) > P.BLOCK_CLIENTS
    for key, found in cells.items():
        r, known = got[key], sorted(kw for _, kw in found if kw is not None)
        assert r.n_clients == least[key].n_clients == len({c for c, _ in found if c is not None})
        assert r.n_missing == sum(kw is None for _, kw in found)
        assert r.n_new_clients == sum(c is not None and first[c] == key[1] for c, _ in found)
        if known:
            assert r.total_kw == pytest.approx(sum(known)) and r.mean_kw == pytest.approx(statistics.fmean(known))
            assert (r.min_kw, r.max_kw, r.median_kw) == (known[0], known[-1], known[math.ceil(len(known) / 2) - 1])
        else:
            assert r.total_kw is None and r.mean_kw is None and r.median_kw is None
        assert r.std_kw == (pytest.approx(statistics.stdev(known)) if len(known) > 1 else None)


def test_client_numbers_are_dense_and_days_add_up(spark):
    rows, df = messy_readings(spark, 5)
    numbers = P.client_numbers(df, together=50)
    listed = [r._number for r in numbers.collect()]
    assert sorted(listed) == list(range(len({r[0] for r in rows if r[0] is not None})))
    blocks = P.client_blocks(df, numbers, P.KEYS).withColumn("day", F.to_date("datetime_utc"))
    want = defaultdict(set)
    for c, g, t, _, _ in rows:
        want[g, t.date()] |= {c} - {None}
    assert {k: r.n_clients for k, r in by_key(P.distinct_clients(blocks, ["community_code", "day"]), "community_code", "day").items()} == {
        k: len(v) for k, v in want.items()}


def test_bits_combine_within_tasks(spark):
    """The plan: numbers by one aggregate, then one scan of the readings whose bits are merged before the exchange."""
    _, df = messy_readings(spark)
    plan = P.build_panel_min(df)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "partial_bit_or" in plan and "count(distinct" not in plan.lower()


# Moments, snapshots, positions


def test_moments_of_parts_are_those_of_the_whole(spark):
    rng = random.Random(4)
    rows = [(i % 9, 1e6 + rng.random()) for i in range(300)] + [(9, None), (10, 7.0)]
    parts = spark.createDataFrame(rows, "part int, v double").groupBy("part").agg(moments("v").alias("m"))
    m = F.col("m")
    whole = parts.agg(merged(F.collect_list("m")).alias("m")).select(m["n"], mean_of(m), std_of(m)).first()
    values = [v for _, v in rows if v is not None]
    assert tuple(whole) == (len(values), pytest.approx(statistics.fmean(values)), pytest.approx(statistics.stdev(values), rel=1e-9))
    one = parts.filter("part >= 9").agg(merged(F.collect_list("m")).alias("m")).select(m["n"], mean_of(m), std_of(m)).first()
    assert tuple(one) == (1, 7.0, None)
    none = parts.filter("part = 9").agg(merged(F.collect_list("m")).alias("m")).select(m["n"], mean_of(m), std_of(m)).first()
    assert tuple(none) == (0, None, None)


def madrid(t):
    """Offset by the two clock changes of 2025."""
    return timedelta(hours=2 if datetime(2025, 3, 30, 1) <= t < datetime(2025, 10, 26, 1) else 1)


@pytest.mark.parametrize("start", [datetime(2025, 3, 20), datetime(2025, 10, 16)])
def test_snapshot_over_a_change_of_clocks(spark, start):
    """Days of 23 and 25 hours: a trailing day is 24 hours whatever the clock says."""
    rng, rows = random.Random(7), []
    for code in ("N", "S"):
        for i in range(25 * 96):
            t = start + timedelta(minutes=15 * i)
            if rng.random() < 0.05:
                continue
            local = t + madrid(t)
            rows.append((code, t, local, None if rng.random() < 0.1 else rng.random(), i, local.date()))
    df = spark.createDataFrame(rows, "community_code string, datetime_utc timestamp_ntz, datetime_local timestamp_ntz, alpha double, "
                                     "n_clients bigint, target_date date")
    got, old = by_key(A.cutoff_snapshot(df), "community_code", "target_date"), by_key(A.cutoff_snapshot_by_rows(df), "community_code", "target_date")
    assert set(got) == set(old) and len(got) > 40
    for key, r in got.items():
        day = [x for x in rows if x[0] == key[0] and x[2].time() == datetime(2025, 1, 1, 11, 45).time() and x[2].date() == key[1] - timedelta(days=1)]
        cut = max(x[1] for x in day)
        def known(hours):
            return [x[3] for x in rows if x[0] == key[0] and x[3] is not None and timedelta(0) <= cut - x[1] < timedelta(hours=hours)]
        week, last = known(7 * 24), known(24)
        assert r.sn_alpha_mean_24h == (pytest.approx(statistics.fmean(last)) if last else None)
        assert r.sn_alpha_mean_7d == pytest.approx(statistics.fmean(week)) == pytest.approx(old[key].sn_alpha_mean_7d)
        assert r.sn_alpha_std_7d == (pytest.approx(statistics.stdev(week)) if len(week) > 1 else None)
        assert (r.sn_alpha_last, r.n_clients_at_cutoff) == (old[key].sn_alpha_last, old[key].n_clients_at_cutoff)


def test_snapshot_without_cutoffs(spark, shares_of):
    df = shares_of([("N", at("2025-01-01 03:00:00"), 1.0, 2)])
    assert A.cutoff_snapshot(df).count() == 0


def test_positions_without_a_window_over_all(spark, shares_of):
    rng, rows = random.Random(9), []
    for code, n in (("N", 700), ("S", 3), ("T", 260)):
        stamps = sorted(rng.sample(range(4000), n))
        rows += [(code, datetime(2025, 1, 1) + timedelta(minutes=15 * s), float(i), i) for i, s in enumerate(stamps)]
    rng.shuffle(rows)
    df = shares_of(rows).repartition(3)
    for r in A.numbered(df, block_days=2).collect():
        assert r._number == r.n_clients + 1
    out = A.positional_lags(df, {"a": ("alpha", 20), "b": ("n_clients", 7)})
    assert out.columns == [*df.columns, "a", "b"] and out.count() == len(rows)
    for r in out.collect():
        assert r.a == (r.alpha - 20 if r.alpha >= 20 else None) and r.b == (r.n_clients - 7 if r.n_clients >= 7 else None)
    with pytest.raises(ValueError):
        A.positional_lags(df, {"a": ("alpha", 0)})


# Gaps


def test_gap_intervals_and_slots(spark):
    rng, rows = random.Random(3), []
    for code in ("N", "S", "T", "U", "V"):
        begin = datetime(2025, 1, 1, 0, rng.choice([0, 7]))
        chosen = {"T": [0], "U": [0, 3000], "V": list(range(40))}.get(code) or [i for i in range(2500) if rng.random() < 0.8 and not 300 < i < 1100]
        rows += [(code, begin + timedelta(minutes=15 * i)) for i in chosen]
    rows += [("N", datetime(2025, 1, 10, 3, 1)), ("S", max(t for c, t in rows if c == "S") + timedelta(minutes=50))]  # off the grid
    df = spark.createDataFrame(rows, "community_code string, datetime_utc timestamp_ntz")
    want = []
    for code in ("N", "S", "T", "U", "V"):
        own = [t for c, t in rows if c == code]
        t, held = min(own), set(own)
        while t <= max(own):
            want += [(code, t)] if t not in held else []
            t += timedelta(minutes=15)
    assert sorted(tuple(r) for r in Q.grid_gaps(df).collect()) == sorted(want)
    assert sorted(tuple(r) for r in Q.grid_gaps_by_join(df).collect()) == sorted(want)
    found = Q.gap_intervals(df, block_days=2).collect()
    assert sum(r.n_slots for r in found) == len(want)
    listed = sorted((r.community_code, r.gap_start + timedelta(minutes=15 * i)) for r in found for i in range(r.n_slots))
    assert listed == sorted(want)
    assert all(r.gap_end == r.gap_start + timedelta(minutes=15 * (r.n_slots - 1)) for r in found)
    assert Q.gap_intervals(df.limit(0)).count() == 0


# State


def test_state_merges_in_any_order(spark):
    rows, df = messy_readings(spark, 11, clients=60)
    parts = [df.filter(F.pmod(F.dayofmonth("datetime_utc"), F.lit(3)) == i) for i in range(3)]
    want = steady(S.state_of(df).collect())
    for order in ((0, 1, 2), (2, 0, 1)):
        state = S.state_of(parts[order[0]])
        for i in order[1:]:
            state = S.merged_state(state, S.state_of(parts[i]))
        assert steady(state.collect()) == want
    first = {}
    for c, _, t, _, _ in rows:
        if c is not None:
            first[c] = min(first.get(c, t), t)
    count = Counter((g, t) for c, g, t, _, _ in rows if c is not None and first[c] == t)
    assert {(r.community_code, r.datetime_utc): r.n_new_clients for r in S.new_clients_of(S.state_of(df)).collect()} == count


@pytest.mark.parametrize("unique", [False, True])
def test_panel_of_new_days_needs_no_old_readings(spark, unique):
    _, df = messy_readings(spark, 12, clients=60)
    if unique:
        df = df.filter("client_id IS NOT NULL").dropDuplicates(["client_id", "community_code", "datetime_utc"])
    df.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/messy-{unique}")
    df = spark.read.parquet(path)
    old, new = df.filter(F.col("datetime_utc") < "2025-01-03"), df.filter(F.col("datetime_utc") >= "2025-01-03")
    state = S.state_of(old)
    after = S.merged_state(state, S.state_of(new))
    whole = P.build_panel(df, unique).filter(F.col("datetime_utc") >= "2025-01-03")
    part = S.panel_of_new_days(new, after, unique)
    assert part.columns == whole.columns and steady(part.collect()) == steady(whole.collect())
    revised = S.revised_slots(S.state_of(new), after)
    assert revised.filter("n_after < n_before").count() > 0  # seen earlier after all


# Quantiles


@pytest.mark.parametrize("borders", [63, 3])
def test_quantiles_by_selection(spark, borders):
    rng, rows = random.Random(6), []
    for code, n in (("a", 1), ("b", 2), ("c", 1000), ("d", 999), (None, 57)):
        rows += [(code, rng.choice([rng.gauss(0, 1), 5.0, 10 ** rng.uniform(-9, 9)])) for _ in range(n)]
    rows += [("c", None)] * 5 + [("e", None)] + [("f", 3.0)] * 400
    df = spark.createDataFrame(rows, "code string, v double")
    shares = [0.0, 0.07, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.code, r.share): r.value for r in exact_quantiles(df, ["code"], "v", shares, borders=borders, accuracy=100).collect()}
    for code in ("a", "b", "c", "d", None, "e", "f"):
        known = sorted(v for c, v in rows if c == code and v is not None)
        for s in shares:
            rank = max(1, math.ceil(round(s * len(known), 6)))
            assert got[code, s] == (known[rank - 1] if known else None), (code, s)
    assert len(got) == 7 * len(shares)
    assert exact_quantiles(df.limit(0), ["code"], "v", shares).count() == 0


# Stored tables and folds


def test_rerun_replaces_its_days_only(spark, tmp_path):
    rows = [(d, i, float(i)) for d in days("2025-01-01", 5) for i in range(20)]
    df, path = spark.createDataFrame(rows, "target_date date, i int, v double"), str(tmp_path / "t")
    tables.save_days(df, path)
    again = df.filter(F.col("target_date") == "2025-01-03").filter("i < 7").withColumn("v", F.lit(-1.0))
    for _ in range(2):
        tables.save_days(again, path)
        back = spark.read.parquet(path)
        assert back.count() == 4 * 20 + 7 and back.filter("v = -1").count() == 7


def test_lags_over_buckets_need_no_exchange(spark, shares_of):
    rows = [(c, datetime(2025, 1, 1) + timedelta(hours=6 * i), float(i), i) for c in ("N", "S") for i in range(120)]
    df = A.with_slot_of_day(shares_of(rows))
    tables.save_bucketed(df, "bucketed_shares", ["community_code", A.SLOT_OF_DAY], 4, ["datetime_utc"])
    stored = spark.table("bucketed_shares")
    lagged = A.with_alpha_lags(stored, (2, 7))
    assert "Exchange" not in lagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in A.with_alpha_lags(shares_of(rows), (2, 7))._jdf.queryExecution().executedPlan().toString()
    plain = A.with_alpha_lags(shares_of(rows), (2, 7))
    assert steady(lagged.drop(A.SLOT_OF_DAY).collect()) == steady(plain.collect())
    spark.sql("DROP TABLE bucketed_shares")


def test_fold_table_of_many_windows(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days("2024-12-20", 90))] * 2, "target_date date, _bin int")
    folds = []
    for f in range(200):
        a = date(2024, 12, 1) + timedelta(days=rng.randrange(120))
        folds.append((f, a - timedelta(days=rng.randrange(20)), a, a + timedelta(days=rng.choice([-1, 0, 1, 5, 60]))))
    table = spark.createDataFrame(folds, "fold int, train_end date, valid_start date, valid_end date")
    got = Counter((r.fold, r.role, r.target_date) for r in assign_fold_table(df, table, bin_days=7).collect())
    want = Counter()
    for d, _ in [tuple(r) for r in df.collect()]:
        for f, end, a, b in folds:
            want[f, "train", d] += d < end
            want[f, "valid", d] += a <= d < b
    assert got == +want
    plan = assign_fold_table(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.split("Train")[0] or "BroadcastNestedLoopJoin" not in assign_fold_table(
        df, table, valid_only=True)._jdf.queryExecution().executedPlan().toString()
