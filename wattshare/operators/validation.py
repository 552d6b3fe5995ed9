"""Splits in time: hold-out, purged folds, walk-forward and day-level expanding folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _date(value) -> F.Column:
    return F.lit(str(value)).cast("date")


def holdout(df: DataFrame, start: str, purge_days: int = 0, end: str | None = None, date: str = "target_date") -> DataFrame:
    """Label rows ``train`` (before ``start`` less the purge) or ``valid`` ([start, end)); drop the rest."""
    d = F.col(date)
    valid = d >= _date(start)
    if end is not None:
        valid = valid & (d < _date(end))
    train = d < F.date_sub(_date(start), purge_days)
    return df.withColumn("split", F.when(train, "train").when(valid, "valid")).filter(F.col("split").isNotNull())


def assign_folds(df: DataFrame, folds: Sequence[tuple[str, str, str]], date: str = "target_date") -> DataFrame:
    """One row per (row, fold, role) for fixed fold bounds ``(train_end, valid_start, valid_end)``.

    Train is everything before ``train_end``; days up to ``valid_start`` are purged.  The bounds are
    a short parameter list, so the range test is an expression on each row, not a join.
    """
    d = F.col(date)
    roles = []
    for i, (train_end, valid_start, valid_end) in enumerate(folds):
        role = F.when(d < _date(train_end), "train").when(
            (d >= _date(valid_start)) & (d < _date(valid_end)), "valid")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(i).alias("fold"), role.alias("role"))))
    return df.withColumn("_m", F.explode(F.array_compact(F.array(*roles)))).select(*df.columns, "_m.fold", "_m.role")


#: Days of a bin of the range join.
BIN_DAYS = 32


def assign_fold_table(
    df: DataFrame, folds: DataFrame, date: str = "target_date", bin_days: int = BIN_DAYS, valid_only: bool = False,
) -> DataFrame:
    """As ``assign_folds`` for bounds held in a table ``fold, train_end, valid_start, valid_end``, however many.

    Intervals meet rows in bins of days: an interval has a row for each bin it touches, a row of ``df`` lies in one, and the
    exact test is part of that join, so no nested loop and no row per day of a window.  Train rows
    of a fold begin with the first day of ``df``.  Rows come once per fold and role they belong to.
    """
    valid = folds.select("fold", F.lit("valid").alias("role"), F.col("valid_start").alias("_from"), F.col("valid_end").alias("_until"))
    spans = valid
    if not valid_only:
        first = df.agg(F.min(date).alias("_from"))
        train = folds.select("fold", F.lit("train").alias("role"), F.col("train_end").alias("_until"))
        # One row, the first day.
        spans = valid.unionByName(train.join(F.broadcast(first)))
    def bin_of(day):
        return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / F.lit(bin_days))
    last = F.date_sub("_until", 1)
    bins = spans.filter(F.col("_from") < F.col("_until")).withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col("_from")), bin_of(last))))
    binned = df.withColumn("_bin", bin_of(F.col(date)))
    day = binned[date]
    met = binned.join(bins, (binned["_bin"] == bins["_bin"]) & (day >= bins["_from"]) & (day < bins["_until"]))
    return met.select(*[binned[c] for c in df.columns], "fold", "role")


def day_folds(days: DataFrame, n_splits: int = 5, gap_days: int = 14, date: str = "target_date") -> DataFrame:
    """Expanding day-level folds, one row per (fold, role, day).

    With n days each test block has n div (splits + 1) days and the remainder joins the first train
    block.  Validation days closer than ``gap_days`` to the last train day are dropped, and so is a
    fold left without any.  The day list grows with the calendar alone.
    """
    if n_splits < 1:
        raise ValueError("n_splits must be positive")
    calendar = days.select(F.col(date).alias("d")).distinct().agg(F.sort_array(F.collect_list("d")).alias("days"))
    n = F.size("days")
    size = F.floor(n / (n_splits + 1)).cast("int")
    folds = (
        calendar.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .withColumns({"_size": size, "_cut": n - (n_splits - F.col("fold")) * size})
        .filter((F.col("_size") > 0) & (F.col("_cut") > 0))
        .withColumn("train_end", F.element_at("days", F.col("_cut")))
    )
    listed = folds.select("fold", "train_end", "_cut", "_size", F.posexplode("days").alias("_i", date))
    in_test = F.col("_i").between(F.col("_cut"), F.col("_cut") + F.col("_size") - 1)
    far_enough = F.col(date) >= F.date_add("train_end", gap_days)
    role = F.when(F.col("_i") < F.col("_cut"), "train").when(in_test & far_enough, "valid")
    assigned = listed.select("fold", "train_end", date, role.alias("role")).filter(F.col("role").isNotNull())
    usable = assigned.filter(F.col("role") == "valid").select("fold").distinct()
    return assigned.join(usable, "fold", "left_semi")


def fold_bounds(folds: DataFrame, date: str = "target_date") -> DataFrame:
    """First and last train and validation day of every fold."""
    def edge(fn, role):
        return fn(F.when(F.col("role") == role, F.col(date)))
    return folds.groupBy("fold").agg(
        edge(F.min, "train").alias("train_start"), edge(F.max, "train").alias("train_end"),
        edge(F.min, "valid").alias("valid_start"), edge(F.max, "valid").alias("valid_end"))
