"""The demand share, its exact-time lags and its trailing statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshare.features import LAG_DAYS
from wattshare.functions.moments import mean_of, merged, moments, std_of
from wattshare.functions.rowwise import demand_share, row_mean, row_median
from wattshare.functions.timegrid import (
    DAY_SECONDS, days_later, epoch_day, epoch_seconds, hour_start, is_clock, second_of_day,
)

ENTITY = ("community_code",)
#: Seconds since the UTC day began, as a column of stored tables (``with_slot_of_day``).
SLOT_OF_DAY = "slot_of_day"


def with_slot_of_day(df: DataFrame) -> DataFrame:
    return df.withColumn(SLOT_OF_DAY, second_of_day("datetime_utc"))


def hourly_demand(demand: DataFrame) -> DataFrame:
    """One row per hour, so that finer input cannot multiply panel rows."""
    return demand.groupBy(hour_start("datetime_utc").alias("hour_utc")).agg(F.avg("value").alias("D_mw"))


def with_demand(panel: DataFrame, demand: DataFrame, exact: bool = False) -> DataFrame:
    """Attach the demand forecast of the hour, or of the very stamp with ``exact``.

    No hint: the forecast is hourly, so Spark broadcasts it when its measured size allows.
    """
    if exact:
        side = demand.groupBy("datetime_utc").agg(F.avg("value").alias("D_mw"))
        return panel.join(side, "datetime_utc", "left").select(*panel.columns, "D_mw")
    keyed = panel.withColumn("hour_utc", hour_start("datetime_utc"))
    return keyed.join(hourly_demand(demand), "hour_utc", "left").select(*panel.columns, "D_mw")


def with_alpha(panel: DataFrame, demand: DataFrame, exact: bool = False) -> DataFrame:
    return with_demand(panel, demand, exact).withColumn(
        "alpha", demand_share("total_kw", "n_clients", "D_mw"))


def check_lag_days(days: Sequence[int]) -> None:
    """A lag under two days would see values published after the cutoff."""
    if not days or any(d < 2 for d in days):
        raise ValueError("every lag must be at least 2 days")


def with_lags(df: DataFrame, lags: dict[str, tuple[str, int]], entity: Sequence[str] = ENTITY) -> DataFrame:
    """Values exactly N days earlier, ``{new column: (source column, days)}``.

    A shift by whole days never leaves a slot of the day, so one shuffle on (entity, slot of day)
    serves every lag, and each sort holds one row per day.  A table stored with the column ``SLOT_OF_DAY`` and in buckets
    by entity and that column is not shuffled at all.
    """
    check_lag_days([n for _, n in lags.values()])
    stored = SLOT_OF_DAY in df.columns
    keyed = df.withColumn("_day", epoch_day("datetime_utc"))
    keyed = keyed if stored else keyed.withColumn("_tod", second_of_day("datetime_utc"))
    base = Window.partitionBy(*entity, SLOT_OF_DAY if stored else "_tod").orderBy("_day")
    out = keyed.withColumns(
        {name: F.max(src).over(base.rangeBetween(-n, -n)) for name, (src, n) in lags.items()})
    return out.drop("_day", "_tod")


def with_alpha_lags(df: DataFrame, days: Sequence[int] = LAG_DAYS, entity: Sequence[str] = ENTITY) -> DataFrame:
    """``alpha_lag_<n>d`` for every n, and the mean of those available."""
    names = [f"alpha_lag_{n}d" for n in days]
    lagged = with_lags(df, {name: ("alpha", n) for name, n in zip(names, days)}, entity)
    return lagged.withColumn("alpha_lag_mean", row_mean(names))


def with_lag_join(df: DataFrame, column: str, days: int, name: str, entity: Sequence[str] = ENTITY) -> DataFrame:
    """The same lag as a time-shifted self join: a shuffle per lag, kept to cross-check the window form."""
    check_lag_days([days])
    keys = [*entity, "datetime_utc"]
    past = df.select(*entity, days_later("datetime_utc", days).alias("datetime_utc"), F.col(column).alias(name))
    return df.join(past, keys, "left")


def numbered(df: DataFrame, entity: Sequence[str] = ENTITY, block_days: int = 28) -> DataFrame:
    """``df`` with ``_number``, the row's place in its entity's history from 1, and the bounds of no window but a block's.

    Rows are counted per block of days, the sums of earlier blocks give where a block begins, and rows are numbered
    within their block.
    """
    blocked = df.withColumn("_nblock", F.floor(epoch_seconds("datetime_utc") / F.lit(block_days * DAY_SECONDS)))
    keys = [*entity, "_nblock"]
    before = Window.partitionBy(*entity).orderBy("_nblock").rowsBetween(Window.unboundedPreceding, -1)
    # A row per entity and block.
    begins = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nrows")).withColumn(
        "_nbegin", F.coalesce(F.sum("_nrows").over(before), F.lit(0))).drop("_nrows")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("datetime_utc"))
    return blocked.withColumn("_nplace", place).join(begins, keys).withColumn(
        "_number", F.col("_nbegin") + F.col("_nplace")).drop("_nblock", "_nplace", "_nbegin")


def positional_lags(df: DataFrame, lags: dict[str, tuple[str, int]], entity: Sequence[str] = ENTITY) -> DataFrame:
    """Values N rows earlier, ``{new column: (source column, rows)}``: equal to time lags only on a gap-free series.

    Rows are numbered without a window over a whole history, and numbers cut into chunks of four times the longest lag; the last
    rows of a chunk are repeated as lead-in of the next, so a window partition holds five lags of one entity and
    one shuffle serves all lags.
    """
    longest = max(rows for _, rows in lags.values())
    if min(rows for _, rows in lags.values()) < 1:
        raise ValueError("a positional lag is at least one row")
    chunk = F.floor(F.col("_number") / F.lit(4 * longest))
    lead_in = F.col("_number") >= (F.col("_nhome") + 1) * (4 * longest) - longest
    spread = numbered(df, entity).withColumn("_nhome", chunk).withColumn("_nchunk", F.explode(
        F.when(lead_in, F.array("_nhome", F.col("_nhome") + 1)).otherwise(F.array("_nhome"))))
    base = Window.partitionBy(*entity, "_nchunk").orderBy("_number")
    out = spread.withColumns({name: F.lag(src, rows).over(base) for name, (src, rows) in lags.items()})
    return out.filter(F.col("_nchunk") == F.col("_nhome")).drop("_number", "_nhome", "_nchunk")


def positional_lag(df: DataFrame, column: str, rows: int, name: str, entity: Sequence[str] = ENTITY) -> DataFrame:
    """One lag of ``positional_lags``."""
    return positional_lags(df, {name: (column, rows)}, entity)


def robust_lag(df: DataFrame, cols: Sequence[str], name: str = "alpha_lag_median4") -> DataFrame:
    return df.withColumn(name, row_median(cols))


def trailing_stats(
    df: DataFrame, column: str, stats: dict[str, tuple[str, int]], entity: Sequence[str] = ENTITY,
) -> DataFrame:
    """Trailing statistics at every row: ``{new column: ("mean" | "std", seconds)}``.

    The frame of N seconds holds the current row and rows under N seconds older.  History is cut
    into blocks of four frames; rows near the end of a block are repeated as lead-in of the next, so a
    window partition holds five frames of one entity however long the history grows.
    """
    functions = {"mean": F.avg, "std": F.stddev_samp}
    longest = max(seconds for _, seconds in stats.values())
    block = 4 * longest
    home = F.floor(F.col("_sec") / F.lit(block))
    near_end = F.col("_sec") > (home + 1) * block - longest
    spread = (
        df.withColumn("_sec", epoch_seconds("datetime_utc"))
        .withColumn("_home", home)
        .withColumn("_block", F.explode(
            F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    )
    base = Window.partitionBy(*entity, "_block").orderBy("_sec")
    out = spread.withColumns({
        name: functions[fn](column).over(base.rangeBetween(-(seconds - 1), 0))
        for name, (fn, seconds) in stats.items()
    })
    return out.filter(F.col("_block") == F.col("_home")).drop("_sec", "_home", "_block")


def same_dow_mean(df: DataFrame, column: str, name: str, days: int = 28, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Mean at the same slot and weekday over the previous ``days`` days, today excluded."""
    keyed = df.withColumns({
        "_day": epoch_day("datetime_utc"), "_tod": second_of_day("datetime_utc"),
        "_dow": F.weekday("datetime_utc")})
    w = Window.partitionBy(*entity, "_tod", "_dow").orderBy("_day").rangeBetween(-days, -1)
    return keyed.withColumn(name, F.avg(column).over(w)).drop("_day", "_tod", "_dow")


def _cutoff_rows(df: DataFrame, cutoff_hour: int, **values: str) -> DataFrame:
    """The last slot published before the cutoff, per entity and local day: ``new name = column``.

    Should the local clock show that slot twice in one day, the later one counts.
    """
    at_cutoff = df.filter(is_clock("datetime_local", cutoff_hour - 1, 45))
    return at_cutoff.groupBy(
        "community_code", F.date_add(F.to_date("datetime_local"), 1).alias("target_date")
    ).agg(F.max("datetime_utc").alias("cutoff_utc"),
          *[F.max_by(src, "datetime_utc").alias(name) for name, src in values.items()])


def client_count_snapshot(df: DataFrame, cutoff_hour: int = 12) -> DataFrame:
    """Client count at the cutoff of the day before, per (community, target date)."""
    return _cutoff_rows(df, cutoff_hour, n_clients_at_cutoff="n_clients").drop("cutoff_utc")


def cutoff_snapshot(df: DataFrame, cutoff_hour: int = 12) -> DataFrame:
    """What is known at the cutoff of day D-1, one row per (community, target date D).

    Last share, trailing 24 h mean, trailing 7 d mean and standard deviation, client count.  Every UTC day is cut at the
    times of day at which cutoffs fall (one, or two where clocks change), and each part is reduced to its moments by one
    combinable aggregation: no row of the history is repeated or joined.  A trailing day or week is a whole number of parts, so a
    cutoff merges the few moments of its eight days.  Only the distinct times of day of the cutoffs, as many as
    the zone has offsets, are read by the driver.
    """
    cutoffs = _cutoff_rows(df, cutoff_hour, sn_alpha_last="alpha", n_clients_at_cutoff="n_clients")
    # Cutoff stamps share their minute; what differs is the zone's offset.
    times = sorted(r[0] for r in df.filter(is_clock("datetime_local", cutoff_hour - 1, 45)).select(
        second_of_day("datetime_utc").alias("t")).distinct().collect())
    bounds = F.array(*[F.lit(t) for t in times]).cast("array<bigint>")

    def part_of(second):
        """How many of the times lie before the second: a row at a time itself belongs to the part that ends there."""
        return F.size(F.filter(bounds, lambda t: t < second))

    parts = df.filter(F.col("alpha").isNotNull()).groupBy(
        "community_code", epoch_day("datetime_utc").alias("_day"), part_of(second_of_day("datetime_utc")).alias("_part")
    ).agg(moments("alpha").alias("_m"))
    last_day = epoch_day("cutoff_utc")
    reach = cutoffs.select(
        "community_code", "target_date", last_day.alias("_last"), part_of(second_of_day("cutoff_utc")).alias("_own"),
        F.explode(F.sequence(last_day - 7, last_day)).alias("_day"))
    met = reach.join(parts, ["community_code", "_day"])
    back = F.col("_last") - F.col("_day")
    until, since = F.col("_part") <= F.col("_own"), F.col("_part") > F.col("_own")
    in_day = ((back == 0) & until) | ((back == 1) & since)
    in_week = ((back == 0) & until) | back.between(1, 6) | ((back == 7) & since)
    # Eight days by as many parts as there are times, and one.
    week = met.groupBy("community_code", "target_date").agg(
        merged(F.collect_list(F.when(in_day, F.col("_m")))).alias("_in_day"),
        merged(F.collect_list(F.when(in_week, F.col("_m")))).alias("_in_week"))
    return cutoffs.join(week, ["community_code", "target_date"], "left").select(
        "community_code", "target_date", "sn_alpha_last", mean_of(F.col("_in_day")).alias("sn_alpha_mean_24h"),
        mean_of(F.col("_in_week")).alias("sn_alpha_mean_7d"), std_of(F.col("_in_week")).alias("sn_alpha_std_7d"),
        "n_clients_at_cutoff")


def cutoff_snapshot_by_rows(df: DataFrame, cutoff_hour: int = 12) -> DataFrame:
    """The same from the rows themselves, each met by up to eight cutoffs: kept to cross-check the merged moments."""
    cutoffs = _cutoff_rows(df, cutoff_hour, sn_alpha_last="alpha", n_clients_at_cutoff="n_clients")
    last_day = epoch_day("cutoff_utc")
    reach = cutoffs.select(
        "community_code", "target_date", epoch_seconds("cutoff_utc").alias("_cut"),
        F.explode(F.sequence(last_day - 7, last_day)).alias("_day"))
    history = df.filter(F.col("alpha").isNotNull()).select(
        "community_code", "alpha", epoch_seconds("datetime_utc").alias("_sec"), epoch_day("datetime_utc").alias("_day"))
    week = (
        history.join(reach, ["community_code", "_day"])
        .withColumn("_age", F.col("_cut") - F.col("_sec"))
        .filter(F.col("_age").between(0, 7 * DAY_SECONDS - 1))
        .groupBy("community_code", "target_date")
        .agg(
            F.avg(F.when(F.col("_age") < DAY_SECONDS, F.col("alpha"))).alias("sn_alpha_mean_24h"),
            F.avg("alpha").alias("sn_alpha_mean_7d"),
            F.stddev_samp("alpha").alias("sn_alpha_std_7d"),
        )
    )
    return cutoffs.join(week, ["community_code", "target_date"], "left").select(
        "community_code", "target_date", "sn_alpha_last", "sn_alpha_mean_24h",
        "sn_alpha_mean_7d", "sn_alpha_std_7d", "n_clients_at_cutoff")


def attach_snapshot(df: DataFrame, snapshot: DataFrame) -> DataFrame:
    return df.join(snapshot, ["community_code", "target_date"], "left")
