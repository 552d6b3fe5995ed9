"""Expressions on the time grid.  All stamps are ``TIMESTAMP_NTZ``, so none depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
SLOT_SECONDS = 900


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slot_start(ts: str | Column, width: str = "15 minutes") -> Column:
    """Start of the grid cell that holds ``ts``."""
    return F.window(as_col(ts), width).start


def hour_start(ts: str | Column) -> Column:
    """Start of the hour, staying in ``TIMESTAMP_NTZ`` (``date_trunc`` would not)."""
    return slot_start(ts, "1 hour")


def epoch_seconds(ts: str | Column) -> Column:
    return F.unix_timestamp(as_col(ts))


def epoch_day(ts: str | Column) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(DAY_SECONDS))


def second_of_day(ts: str | Column) -> Column:
    return F.pmod(epoch_seconds(ts), F.lit(DAY_SECONDS))


def utc_to_local(ts: str | Column, zone: str = "Europe/Madrid") -> Column:
    """Wall clock of ``zone``.  The hour repeated in autumn maps to one local hour twice."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_col(ts))


def days_later(ts: str | Column, days: int) -> Column:
    """Exactly ``days`` × 24 hours after a UTC stamp."""
    return as_col(ts) + F.expr(f"INTERVAL '{int(days)}' DAY")


def is_clock(ts: str | Column, hour: int, minute: int) -> Column:
    """True at one wall-clock minute of the day."""
    return (F.hour(as_col(ts)) == hour) & (F.minute(as_col(ts)) == minute)
