"""Dataset, baselines, models, folds, scoring: small portfolios checked against plain Python."""

import math
import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from support import DATA, at, by_key, days, steady
from wattshare import features
from wattshare.operators import baseline as B
from wattshare.operators import diagnostics as D
from wattshare.operators import model as M
from wattshare.operators import quality as Q
from wattshare.operators import validation as V
from wattshare.plans import evaluation
from wattshare.plans.dataset import build_alpha_dataset, build_short_dataset, history_filter
from wattshare.sources.fixtures import Meter

START = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def portfolio(spark):
    """Five clients in two communities, hourly for 40 days, with a hole and some missing readings."""
    rng = random.Random(3)
    rows = []
    for c, code, size in (("a", "N", 50.0), ("b", "N", 5.0), ("c", "N", 4.0), ("d", "S", 6.0), ("e", "S", 3.0)):
        for h in range(40 * 24):
            if c == "d" and h in (100, 101):
                continue
            t = START + timedelta(hours=h)
            kw = None if rng.random() < 0.02 else size * (1 + 0.3 * math.sin(h / 24) + 0.1 * rng.random())
            rows.append((c, code, t, t + timedelta(hours=1), kw))
    readings = spark.createDataFrame(rows, "client_id string, community_code string, datetime_utc timestamp_ntz, "
                                           "datetime_local timestamp_ntz, active_kw double")
    # Quarter-hour slots around the cutoff are needed for the snapshot.
    quarter = [(c, g, t + timedelta(minutes=45), l + timedelta(minutes=45), kw) for c, g, t, l, kw in rows if l.hour == 11]
    readings = readings.unionByName(spark.createDataFrame(quarter, readings.schema))
    demand = spark.createDataFrame([(START + timedelta(hours=h), 1000.0 + h % 24) for h in range(40 * 24)],
                                   "datetime_utc timestamp_ntz, value double")
    return readings.cache(), demand.cache()


def test_dataset_columns_history_and_checks(spark, portfolio):
    readings, demand = portfolio
    df = build_alpha_dataset(readings, demand).cache()
    assert df.columns == features.BOOKKEEPING + ["y"] + features.BASE_FEATURES
    assert df.count() > 0 and df.select("community_code", "datetime_utc").distinct().count() == df.count()
    assert all(r.violations == 0 for r in Q.check_leakage(df, readings, 28).collect())
    assert all(r.violations == 0 for r in Q.check_alpha(df).collect())
    assert df.agg(F.min("target_date")).collect()[0][0] == date(2025, 1, 29)
    unstaged = build_alpha_dataset(readings, demand, stage=False)
    assert steady(unstaged.collect()) == steady(df.collect())
    with pytest.raises(ValueError):
        build_alpha_dataset(readings, demand, lag_days=(1, 7))


def test_null_profile_equals_counts_per_column(spark, portfolio):
    df = build_alpha_dataset(*portfolio, min_history_days=2).cache()
    cols = ["y", *features.BASE_FEATURES]
    got = by_key(Q.null_profile(df, cols), "feature")
    for c in cols:
        assert got[c].n_nulls == df.filter(F.col(c).isNull()).count()


def test_nothing_published_after_the_cutoff_reaches_the_features(spark, portfolio):
    """Rewrite every reading from the cutoff of day D-1 on; features of day D must not move."""
    readings, demand = portfolio
    target, cutoff = date(2025, 2, 5), at("2025-02-04 12:00")
    spoiled = readings.withColumn(
        "active_kw", F.when(F.col("datetime_local") >= F.lit(cutoff), F.lit(-9e9)).otherwise(F.col("active_kw")))
    known = [c for c in features.BASE_FEATURES]

    def rows_of(source):
        df = build_alpha_dataset(source, demand).filter(F.col("target_date") == F.lit(target))
        return steady(df.select("community_code", "datetime_utc", *known).collect())
    before = rows_of(readings)
    assert len(before) > 20 and before == rows_of(spoiled)


def test_short_dataset_has_large_clients_apart(portfolio):
    readings, demand = portfolio
    df = build_short_dataset(readings, demand, top_n=1)
    assert {r.community_code for r in df.select("community_code").distinct().collect()} == {"BIG_a", "N", "S"}
    assert df.columns[7:] == features.SHORT_FEATURES
    assert df.filter((F.col("community_code") == "BIG_a") & (F.col("n_clients") != 1)).count() == 0


def test_history_filter_drops_unlabelled_rows(shares_of):
    df = shares_of([("N", START + timedelta(days=i), None if i == 3 else 1.0, 1) for i in range(5)])
    kept = history_filter(df, 2, label="alpha")
    assert sorted(r.target_date.day for r in kept.collect()) == [3, 5]


def test_residuals_and_their_inverses_round_trip(spark):
    df = spark.createDataFrame([(12.0, 3, 2.0, 1.5, 4), (0.2, 1, 2.0, 0.1, 1), (5.0, 2, 1.0, None, 2)],
                               "total_kw double, n_clients int, D_mw double, alpha_lag_7d double, n_clients_at_cutoff int")
    rows = B.with_baseline(df)
    assert [r.baseline_kw for r in rows.collect()] == [12.0, 0.2, None]
    kw = B.from_residual(B.with_residual(rows, "kw", "correction"), "kw").collect()
    assert [r.pred_kw for r in kw] == [12.0, 0.2, None]
    share = B.with_residual(rows, "alpha", "correction").collect()
    assert share[0].correction == pytest.approx(0.5) and share[2].correction is None
    log = B.with_residual(B.with_baseline(df, 1.0), "log", "correction")
    assert [r.correction for r in log.collect()] == [pytest.approx(0.0), pytest.approx(0.0), None]
    bounded = B.from_residual(rows.withColumn("correction", F.lit(9.0)), "log", bound=0.5).collect()
    assert bounded[0].pred_kw == pytest.approx(12 * math.exp(0.5)) and bounded[2].pred_kw is None
    for call in (lambda: B.with_residual(rows, "x"), lambda: B.from_residual(rows.withColumn("correction", F.lit(1.0)), "x")):
        with pytest.raises(ValueError):
            call()


def test_unknown_parts_count_as_zero_in_the_portfolio(spark):
    df = spark.createDataFrame([(at("2025-01-01"), 5.0, 1.0), (at("2025-01-01"), None, 2.0), (at("2025-01-02"), 3.0, None)],
                               "datetime_utc timestamp_ntz, baseline_kw double, correction double")
    assert {r.datetime_utc.day: r.prediction for r in B.portfolio_forecast(df).collect()} == {1: 8.0, 2: 3.0}


def test_exact_and_positional_baselines_agree_without_gaps(shares_of):
    rows = [("N", START + timedelta(minutes=15 * i), 1.0 + i % 7, 1 + i % 5) for i in range(8 * 96)]
    df = shares_of(rows).withColumn("D_mw", F.lit(10.0)).withColumn("total_kw", F.lit(1.0))
    exact, rows_back = (B.with_baseline_d2(df, positional=p).select("datetime_utc", "baseline_kw") for p in (False, True))
    assert steady(exact.collect()) == steady(rows_back.collect())


@pytest.fixture
def cells(spark):
    rows = [("N", s, d, float(10 * s + d + k)) for s in (0, 1) for d in (1, 2) for k in (0, 1, 5)] + [("S", 0, 1, 1.0)]
    return spark.createDataFrame(rows, "community_code string, mod int, dow int, residual double")


def test_cell_median_falls_back_from_cell_to_slot_to_zero(spark, cells):
    model = M.fit_cell_median(cells, min_rows=5)
    asked = spark.createDataFrame([("N", 1, 2), ("N", 1, 7), ("N", 9, 1), ("S", 0, 1), ("X", 0, 1)],
                                  "community_code string, mod int, dow int")
    got = {tuple(r)[:3]: r.correction for r in model.predict(asked).collect()}
    assert got["N", 1, 2] == 13.0
    assert got["N", 1, 7] == statistics.median([11, 12, 16, 12, 13, 17])
    assert (got["N", 9, 1], got["S", 0, 1], got["X", 0, 1]) == (0.0, 0.0, 0.0)
    assert model.predict(asked).count() == 5


def test_sketch_and_exact_cells_agree_on_odd_counts(cells):
    pick = F.col("community_code") == "N"
    a, b = (M.fit_cell_median(cells.filter(pick), exact=e).table.select("mod", "cells").collect() for e in (True, False))
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_cell_median_never_hurts_full_cells_in_training(cells):
    scored = M.fit_cell_median(cells, min_rows=1).predict(cells)
    assert scored.filter(F.col("community_code") == "N").agg(
        F.sum(F.abs(F.col("residual") - F.col("correction"))) <= F.sum(F.abs("residual"))).collect()[0][0]


def test_fixed_folds_purge_and_overlap(spark):
    df = spark.createDataFrame([(d,) for d in days("2025-01-01", 12)], "target_date date")
    got = V.assign_folds(df, [("2025-01-03", "2025-01-05", "2025-01-07"), ("2025-01-06", "2025-01-08", "2025-01-10")])
    roles = {(r.fold, r.role): [] for r in got.collect()}
    for r in got.collect():
        roles[r.fold, r.role].append(r.target_date.day)
    assert {k: sorted(v) for k, v in roles.items()} == {
        (0, "train"): [1, 2], (0, "valid"): [5, 6], (1, "train"): [1, 2, 3, 4, 5], (1, "valid"): [8, 9]}


@pytest.mark.parametrize("n,splits,gap", [(30, 5, 2), (31, 4, 1), (13, 3, 3), (5, 5, 1), (20, 3, 9)])
def test_day_folds_follow_the_rule(spark, n, splits, gap):
    listed = days("2025-01-01", n)
    got = {}
    for r in V.day_folds(spark.createDataFrame([(d,) for d in listed], "target_date date"), splits, gap).collect():
        got.setdefault(r.fold, {}).setdefault(r.role, []).append(r.target_date)
    want = {}
    size = n // (splits + 1)
    for k in range(splits):
        cut = n - (splits - k) * size
        train, valid = listed[:cut], [d for d in listed[cut:cut + size] if d >= listed[cut - 1] + timedelta(days=gap)]
        if size and valid:
            want[k] = {"train": train, "valid": valid}
    assert {f: {r: sorted(d) for r, d in x.items()} for f, x in got.items()} == want


def test_holdout_with_purge(spark):
    df = spark.createDataFrame([(d,) for d in days("2025-01-01", 20)], "target_date date")
    got = V.holdout(df, "2025-01-15", purge_days=7, end="2025-01-18").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 7, "valid": 3}


def test_portfolio_error_lets_entities_cancel(spark):
    df = spark.createDataFrame(
        [("N", at("2025-01-01"), 10.0, 12.0, 11.0, 0), ("S", at("2025-01-01"), 10.0, 7.0, 9.0, 0), ("N", at("2025-01-02"), 4.0, 4.0, 5.0, 0)],
        "community_code string, datetime_utc timestamp_ntz, total_kw double, baseline_kw double, pred_kw double, fold int")
    r = D.mae(df).collect()[0]
    assert (r.mae_base, r.mae_model, r.n_points) == (0.5, 0.5, 2) and r.lift_pct == pytest.approx(0.0)
    by = by_key(D.lift_by(df, ["community_code"]), "community_code")
    assert by["S"].lift_pct == pytest.approx(100 * (1 - 1 / 3)) and by["N"].lift_pct == pytest.approx(0.0)
    assert [r.date.day for r in D.worst_days(df, 1).collect()] == [2]
    assert D.lift_pivot(df, [0, 1]).columns == ["community_code", "fold_0", "fold_1"]


def _python_cv(readings, demand, n_splits, gap, top_n, min_rows):
    """The report worked out row by row."""
    rows = [tuple(r) for r in readings.select("client_id", "community_code", "datetime_utc", "datetime_local", "active_kw").collect()]
    d_mw = {r[0]: r[1] for r in demand.collect()}
    listed = sorted({r[3].date() for r in rows})
    size = len(listed) // (n_splits + 1)
    out = {}
    for k in range(n_splits):
        cut = len(listed) - (n_splits - k) * size
        train = set(listed[:cut])
        valid = {d for d in listed[cut:cut + size] if d >= listed[cut - 1] + timedelta(days=gap)}
        energy = {}
        for c, _, _, l, kw in rows:
            if l.date() in train:
                energy[c] = energy.get(c, 0.0) + (kw or 0.0)
        big = set(sorted(energy, key=lambda c: (-energy[c], c))[:top_n])
        panel = {}
        for c, g, t, l, kw in rows:
            cell = panel.setdefault(("BIG_" + c if c in big else g, t), [None, set(), l])
            cell[1].add(c)
            if kw is not None:
                cell[0] = (cell[0] or 0.0) + kw

        def alpha(key):
            if key not in panel or panel[key][0] is None:
                return None
            d = d_mw.get(key[1].replace(minute=0))
            return panel[key][0] / (len(panel[key][1]) * d) if d else None
        residuals, scored = {}, []
        for (g, t), (total, _, l) in panel.items():
            past, two = alpha((g, t - timedelta(days=7))), panel.get((g, t - timedelta(days=2)))
            d = d_mw.get(t.replace(minute=0))
            base = past * len(two[1]) * d if past is not None and two is not None and d is not None else None
            slot, dow = l.hour * 4 + l.minute // 15, l.weekday()
            if l.date() in train and base is not None and total is not None:
                for key in ((g, slot, dow), (g, slot), (g,)):
                    residuals.setdefault(key, []).append(total - base)
            if l.date() in valid:
                scored.append((g, t, slot, dow, total, base))
        slots = {}
        for g, t, slot, dow, total, base in scored:
            fix = 0.0
            if len(residuals.get((g,), [])) >= min_rows:
                found = residuals.get((g, slot, dow)) or residuals.get((g, slot))
                fix = statistics.median(found) if found else 0.0
            cell = slots.setdefault(t, [0.0, 0.0])
            cell[0] += total or 0.0
            cell[1] += (base or 0.0) + fix
        if valid:
            out[k] = (statistics.mean(abs(a - p) for a, p in slots.values()), len(slots), min(valid), max(valid))
    return out


def test_cross_validation_against_plain_python(portfolio):
    readings, demand = portfolio
    want = _python_cv(readings, demand, 3, 2, 1, 20)
    for unique in (True, False):
        got = by_key(evaluation.cross_validate(readings, demand, 3, 2, 1, 20, unique_readings=unique), "fold")
        assert set(got) == set(want)
        for fold, (mae, n, first, last) in want.items():
            assert got[fold].mae_kw == pytest.approx(mae) and got[fold].n_points == n
            assert (got[fold].valid_start, got[fold].valid_end) == (first, last)


def test_too_few_days_for_a_fold(readings_of, demand_of):
    with pytest.raises(ValueError, match="too few days"):
        evaluation.cross_validate(readings_of([("a", "N", "2025-01-01 00:00", 1.0)]), demand_of([("2025-01-01 00:00", 1.0)]))


def test_large_clients_differ_between_folds(spark, readings_of):
    """A client that grows later is apart only in the folds whose train days show it."""
    rows = [("a", "N", f"2025-01-{d:02d} 10:00", 10.0) for d in range(1, 21)]
    rows += [("b", "N", f"2025-01-{d:02d} 10:00", 1.0 if d < 8 else 99.0) for d in range(1, 21)]
    readings = readings_of(rows)
    folds = V.day_folds(readings.select(F.to_date("datetime_local").alias("target_date")), 3, 1)
    bounds = V.fold_bounds(folds).orderBy("fold").collect()
    large = evaluation._large_clients_per_fold(readings, bounds, 1)
    assert {r.client_id: r.in_folds for r in large.collect()} == {"a": [0], "b": [1, 2]}
    panel = by_key(evaluation._fold_entities(readings, large, bounds), "fold", "community_code", "datetime_utc")
    t = at("2025-01-09 10:00")
    assert panel[0, "BIG_a", t].total_kw == 10.0 and panel[0, "N", t].total_kw == 99.0
    assert panel[2, "BIG_b", t].total_kw == 99.0 and panel[2, "N", t].n_clients == 1


def test_score_learns_nothing_from_the_horizon(spark, portfolio):
    """Shares of two weeks ahead are lagged values, so spoil only readings with no later use."""
    readings, demand = portfolio
    start, end = "2025-02-08", "2025-02-10"
    spoiled = readings.withColumn("active_kw", F.when(F.col("datetime_local") >= F.lit(start).cast("timestamp_ntz"), 1e7)
                                  .otherwise(F.col("active_kw")))
    one, two = (steady(evaluation.score(r, demand, start, end, top_n=1, min_rows=20).collect()) for r in (readings, spoiled))
    assert one == two and len(one) > 40
    assert all(at(start) <= t < at(end) for t, _ in one)


def test_boosted_trees_learn_and_repeat(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        x, g = rng.uniform(-1, 1), rng.choice("NS")
        rows.append((g, None if i % 50 == 0 else x, (2.0 if x > 0 else -2.0) + (1.0 if g == "N" else 0.0), 1.0 + x * x,
                     date(2025, 1, 1) + timedelta(days=i % 30)))
    df = spark.createDataFrame(rows, "community_code string, x double, y_log double, w double, target_date date").cache()
    options = dict(weight="w", trees=8, depth=3, step=0.5, min_instances=5, stop_date="2025-01-25")
    one, two = (M.fit_gbt(df, "y_log", ["x"], ["community_code"], **options) for _ in range(2))
    scored = one.predict(df)
    error = scored.agg(F.avg(F.abs(F.col("y_log") - F.col("correction")))).collect()[0][0]
    assert error < 0.8 < df.agg(F.avg(F.abs("y_log"))).collect()[0][0]
    assert steady(scored.collect()) == steady(two.predict(df).collect())
    unseen = spark.createDataFrame([("Z", 0.5, 0.0, 1.0, date(2025, 1, 1))], df.schema)
    assert one.predict(unseen).count() == 1
    top = one.importance(spark).collect()
    assert top[0].feature == "x" and sum(r.weight for r in top) == pytest.approx(1.0)


def test_column_without_values_becomes_constant(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (None, None, "b"), (3.0, None, "a")], "x double, y double, c string")
    matrix = M.fit_feature_matrix(df, ["x", "y"], ["c"])
    assert matrix.names == ["x", "y", "x_missing", "y_missing", "c"]
    rows = [r.features for r in M.feature_rows(matrix, df, ["x"]).collect()]
    assert [r[1:4] for r in rows] == [[0.0, 0.0, 1.0], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]]
    assert rows[1][0] in (1.0, 3.0) and [r[4] for r in rows] == [0.0, 1.0, 0.0]


def test_week_windows_may_overlap(spark):
    schema = "community_code string, datetime_utc timestamp_ntz, total_kw double, baseline_kw double, pred_kw double"
    df = spark.createDataFrame([("N", at(f"2025-01-{d:02d}"), 1.0, 2.0, 1.0) for d in range(1, 20)], schema)
    got = by_key(D.week_error(df, ["2025-01-02", "2025-01-05"]), "week_start")
    assert {k.day: v.n_points for k, v in got.items()} == {2: 8, 5: 8}


def test_per_entity_models_skip_small_entities(spark):
    rows = [("N", float(i % 2), float(i % 2)) for i in range(200)] + [("S", 1.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "community_code string, x double, y double").cache()
    models = M.fit_gbt_per_entity(df, "y", ["x"], min_rows=10, trees=2, depth=2, step=1.0, min_instances=1)
    assert list(models) == ["N"]
    out = M.predict_per_entity(models, df)
    assert out.count() == 203 and out.filter(F.col("community_code") == "S").agg(F.max("correction")).collect()[0][0] == 0
    shares = M.top_features(M.importance_table(spark, models), 1).collect()
    assert [(r.community_code, r.feature, r.rank) for r in shares] == [("N", "x", 1)]


def test_blend_sweep_ends_match_the_parts(spark):
    schema = "fold int, community_code string, datetime_utc timestamp_ntz, total_kw double, pred_kw double"
    a = spark.createDataFrame([(0, "N", at("2025-01-01"), 10.0, 12.0), (0, "S", at("2025-01-01"), 5.0, 5.0)], schema)
    b = spark.createDataFrame([(0, "N", at("2025-01-01"), 10.0, 9.0), (0, "S", at("2025-01-01"), 5.0, 5.0)], schema)
    got = {r.weight: r.mae_kw for r in M.blend_sweep(a, b, [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: pytest.approx(1.0), 0.5: pytest.approx(0.5), 1.0: pytest.approx(2.0)}


def test_walk_forward_uses_no_validation_row(spark):
    m = Meter(spark, DATA)
    df = build_alpha_dataset(m.readings, m.demand, m.weather, m.holidays, min_history_days=2, unique_readings=True)
    folds = [("2024-01-20", "2024-01-22", "2024-01-28")]
    spoil = F.when(F.col("target_date") >= F.lit("2024-01-22").cast("date"), 1e6).otherwise(F.col("total_kw"))
    one, two = (evaluation.walk_forward(x, folds, min_rows=1).select("community_code", "datetime_utc", "pred_kw").collect()
                for x in (df, df.withColumn("total_kw", spoil)))
    assert steady(one) == steady(two) and len(one) > 0


def test_ranking_of_many_rows_spreads_over_parts(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") * 37 % 5000).alias("v"))
    plain = D.top_per_group(df, ["g"], [F.desc("v")], 1000)
    spread = D.top_per_group(df, ["g"], [F.desc("v")], 1000, spread="k")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert plan.count("pmod(xxhash64") >= 1  # the first ranking is dealt by parts


def test_a_boosted_score_follows_the_weather(spark, readings_of, demand_of):
    rows, demand, weather = [], [], []
    start = datetime(2024, 1, 1)
    for h in range(24 * 28):
        t = start + timedelta(hours=h)
        warm = float((h * 7) % 20)
        rows += [(c, "a", t.isoformat(sep=" "), 10.0 + warm) for c in ("1", "2")]
        demand.append((t.isoformat(sep=" "), 100.0))
        weather.append(("a", t + timedelta(hours=1), warm))
    schema = "community_code string, datetime_local timestamp_ntz, temperature_2m double"
    learner = M.Boosted(("qhour", "temperature_2m"), options=dict(trees=2, depth=2, min_instances=5))

    def run(shift):
        sky = spark.createDataFrame([(c, t, w + (shift if t >= datetime(2024, 1, 22) else 0)) for c, t, w in weather], schema)
        out = evaluation.score(readings_of(rows), demand_of(demand), "2024-01-22", "2024-01-29", sky, top_n=0, learner=learner)
        return {r.datetime_15min: r.prediction for r in out.collect()}

    assert run(0.0) != run(-99.0)
