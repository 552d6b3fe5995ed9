"""Seasonal baseline, residual targets and their inverses, portfolio totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshare.functions.rowwise import clip, demand_share, safe_log
from wattshare.operators.alpha import ENTITY, positional_lags, with_lags


def with_baseline(df: DataFrame, floor: float | None = None) -> DataFrame:
    """Last week's share × client count at the cutoff × demand forecast."""
    value = F.col("alpha_lag_7d") * F.col("n_clients_at_cutoff") * F.col("D_mw")
    return df.withColumn("baseline_kw", value if floor is None else clip(value, lower=floor))


def with_baseline_d2(
    df: DataFrame, positional: bool = False, slots_per_day: int = 96, entity: Sequence[str] = ENTITY,
) -> DataFrame:
    """The same with the client count of two days ago.

    Lags are exact in time; ``positional`` counts rows instead, right only on gap-free series.
    """
    if positional:
        lagged = positional_lags(df, {
            "alpha_d7": ("alpha", 7 * slots_per_day), "n_clients_d2": ("n_clients", 2 * slots_per_day)}, entity)
    else:
        lagged = with_lags(df, {"alpha_d7": ("alpha", 7), "n_clients_d2": ("n_clients", 2)}, entity)
    return lagged.withColumn("baseline_kw", F.col("alpha_d7") * F.col("n_clients_d2") * F.col("D_mw"))


def with_residual(df: DataFrame, kind: str = "kw", name: str = "residual") -> DataFrame:
    """What is left to learn: kW, share difference, or log ratio (both sides at least 1 kW)."""
    targets = {
        "kw": lambda: F.col("total_kw") - F.col("baseline_kw"),
        "alpha": lambda: demand_share("total_kw", "n_clients", "D_mw") - F.col("alpha_lag_7d"),
        "log": lambda: safe_log("total_kw") - safe_log("baseline_kw"),
    }
    if kind not in targets:
        raise ValueError(f"unknown residual kind: {kind}")
    return df.withColumn(name, targets[kind]())


def from_residual(
    df: DataFrame, kind: str = "kw", correction: str = "correction", bound: float | None = None,
    name: str = "pred_kw",
) -> DataFrame:
    """Undo ``with_residual``; ``bound`` limits a log correction to ±bound and the result to ≥ 0."""
    c = F.col(correction)
    if kind == "kw":
        value = F.col("baseline_kw") + c
    elif kind == "alpha":
        value = (F.col("alpha_lag_7d") + c) * F.col("n_clients_at_cutoff") * F.col("D_mw")
    elif kind == "log":
        value = F.col("baseline_kw") * F.exp(c if bound is None else clip(c, -bound, bound))
        value = value if bound is None else clip(value, lower=0.0)
    else:
        raise ValueError(f"unknown residual kind: {kind}")
    return df.withColumn(name, value)


def with_log_context(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "log_clients": safe_log("n_clients_at_cutoff"), "log_dmw": safe_log("D_mw"),
        "baseline_log": safe_log("baseline_kw")})


def with_reversion(df: DataFrame, levels: Sequence[str], lag: str = "alpha_lag_7d") -> DataFrame:
    """``rev_<level>``: log ratio of each known level of the share to the lag that the baseline repeats.

    A week-old share far from its level is expected to come back to it; a linear learner can use that.
    """
    def ratio_of(level):
        return F.when((F.col(level) > 0) & (F.col(lag) > 0), F.ln(F.col(level) / F.col(lag)))
    return df.withColumns({f"rev_{c}": ratio_of(c) for c in levels})


def training_rows(df: DataFrame, floor: float = 1.0) -> DataFrame:
    """Rows with a weekly lag, their floored baseline, and the log-ratio target ``y_log``."""
    lagged = with_baseline(df.dropna(subset=["alpha_lag_7d"]), floor)
    return with_residual(lagged, "log", "y_log").withColumn("total_pos", clip("total_kw", lower=floor))


def portfolio(df: DataFrame, columns: dict[str, str], by: Sequence[str] = ("datetime_utc",)) -> DataFrame:
    """Sum entities per stamp: ``{output: input column}``."""
    return df.groupBy(*by).agg(*[F.sum(src).alias(out) for out, src in columns.items()])


def portfolio_forecast(df: DataFrame, by: Sequence[str] = ("datetime_utc",)) -> DataFrame:
    """Baseline plus correction summed over entities; an unknown part counts as 0."""
    final = F.coalesce("baseline_kw", F.lit(0.0)) + F.coalesce("correction", F.lit(0.0))
    return portfolio(df.withColumn("_final", final), {"prediction": "_final"}, by)
