"""Null-aware row-wise expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattshare.functions.timegrid import as_col


def clip(c: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` and ``least`` would skip it)."""
    c = as_col(c)
    bounded = c
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(lower))
    if upper is not None:
        bounded = F.least(bounded, F.lit(upper))
    return F.when(c.isNotNull(), bounded)


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` where the denominator is positive, else NULL."""
    return F.when(as_col(den) > 0, as_col(num) / as_col(den))


def demand_share(total: str | Column, clients: str | Column, demand: str | Column) -> Column:
    """Load per client as a share of national demand; NULL unless every part is usable."""
    total, clients, demand = as_col(total), as_col(clients), as_col(demand)
    usable = (clients > 0) & (demand > 0) & total.isNotNull()
    return F.when(usable, total / (clients * demand))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the non-null values in a row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    known = reduce(lambda a, b: a + b, [flag(F.col(c).isNotNull()) for c in cols])
    return F.when(known > 0, total / known)


def row_median(cols: Sequence[str]) -> Column:
    """Median of the non-null values in a row."""
    known = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(known)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.get(known, low - 1) + F.get(known, high - 1)) / 2)


def safe_log(c: str | Column, floor: float = 1.0) -> Column:
    return F.ln(clip(c, lower=floor))


def percent_gain(reference: str | Column, model: str | Column) -> Column:
    """How much smaller ``model`` is than ``reference``, in percent."""
    return (F.lit(1.0) - ratio(model, reference)) * 100
